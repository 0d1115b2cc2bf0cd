"""What the test modules share. No module imports a conftest: there is one for each folder, under one name."""

SF = "/root/testdata/sf0.001"


def values(df, *columns):
    rows = df.select(*columns).collect() if columns else df.collect()
    return [tuple(r) for r in rows]
