"""The organization catalog: base organizations, their parents, external ids and file-name tokens.

The catalog itself is input (a table or a list of rows); no site's names are built in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import base_org, blank_to_null, bulk_org
from meterlake.operators.numbering import numbered
from meterlake.schema import BULK, BULK_SUFFIX, ORGANIZATIONS_SCHEMA

OTHER = "Other"


def organizations(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Catalog from rows with name and optionally external_id, parent_name, filename_tokens and
    sort_order (else the position, in tens)."""
    names = ORGANIZATIONS_SCHEMA.fieldNames()
    full = [{"sort_order": i * 10, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ORGANIZATIONS_SCHEMA)


def base_organizations(catalog: DataFrame) -> DataFrame:
    return catalog.select("name", "sort_order").orderBy("sort_order", "name")


def organization_options(catalog: DataFrame) -> DataFrame:
    """Every base organization followed by its bulk twin."""
    twins = F.posexplode(F.array("name", bulk_org(F.col("name")))).alias("twin", "org")
    return catalog.select("sort_order", "name", twins).orderBy("sort_order", "name", "twin").select("org", "sort_order", "twin")


def parents(catalog: DataFrame) -> DataFrame:
    return catalog.select(blank_to_null(F.col("parent_name")).alias("parent")).where(F.col("parent").isNotNull()).distinct()


def parent_map(catalog: DataFrame) -> DataFrame:
    """Base name to parent; a parent maps to itself."""
    own = parents(catalog).select(F.col("parent").alias("name"), "parent")
    child = catalog.select("name", blank_to_null(F.col("parent_name")).alias("parent")).where(F.col("parent").isNotNull())
    return own.unionByName(child.join(own.select("name"), "name", "left_anti"))


def parent_of(df: DataFrame, org: str, catalog: DataFrame) -> DataFrame:
    """Adds ``parent`` for a column of organization names, "Other" where the catalog has none."""
    lookup = parent_map(catalog).select(F.col("name").alias("_base"), "parent")
    joined = df.withColumn("_base", base_org(F.col(org))).join(lookup, "_base", "left")
    return joined.withColumn("parent", F.coalesce("parent", F.lit(OTHER))).drop("_base")


def focus_labels(focus: str | None, catalog: DataFrame, include_self: bool = False) -> DataFrame:
    """Organization labels behind a focus choice: the children of a parent with their bulk twins,
    or the one label itself. ``include_self`` adds the parent's own rows."""
    children = catalog.where(F.trim("parent_name") == focus)
    if not include_self:
        children = children.where(F.col("name") != focus)
    twins = children.select(F.explode(F.array("name", bulk_org(F.col("name")))).alias("org"))
    is_parent = parents(catalog).agg(F.max(F.col("parent") == focus)).scalar()
    alone = catalog.sparkSession.range(1).where(~F.coalesce(is_parent, F.lit(False))).select(F.lit(focus).alias("org"))
    return twins.unionByName(alone).distinct()


def in_focus(df: DataFrame, focus: str | None, catalog: DataFrame, include_self: bool = False) -> DataFrame:
    """Rows of a focus choice; "All orgs" or nothing keeps all rows."""
    if focus in (None, "", "All", "All orgs"):
        return df
    return df.join(focus_labels(focus.strip(), catalog, include_self), "org", "left_semi")


def focus_options(catalog: DataFrame, present: DataFrame) -> DataFrame:
    """"All orgs", the parents by name, then the organizations present in the data by name."""
    spark = catalog.sparkSession
    everything = spark.range(1).select(F.lit(0).alias("rank"), F.lit("All orgs").alias("option"))
    roots = parents(catalog).select(F.lit(1).alias("rank"), F.col("parent").alias("option"))
    seen = present.where(F.trim("org") != "").select(F.lit(2).alias("rank"), F.col("org").alias("option")).distinct()
    both = everything.unionByName(roots).unionByName(seen)
    return both.groupBy("option").agg(F.min("rank").alias("rank")).orderBy("rank", "option")


def organization_names(df: DataFrame, catalog: DataFrame, id_column: str = "org_id") -> DataFrame:
    """Adds ``org``: the catalog name of an external id, else the id itself, "Unknown" if blank."""
    key = blank_to_null(F.col(id_column).cast("string"))
    lookup = (
        catalog.where(blank_to_null(F.col("external_id")).isNotNull())
        .groupBy(F.col("external_id").alias("_id")).agg(F.min("name").alias("_name"))
    )
    joined = df.drop("org").withColumn("_id", key).join(lookup, "_id", "left")
    return joined.withColumn("org", F.coalesce("_name", "_id", F.lit("Unknown"))).drop("_id", "_name")


def id_map(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.trim("external_id") != "").select("external_id", "name")


def ensure_organizations(catalog: DataFrame, names: DataFrame, first_order: int | None = None) -> DataFrame:
    """Catalog plus the base organizations of ``names`` (column org, and optionally external_id,
    parent_name and filename_tokens) that it lacks, in name order, ten apart after the highest sort
    order (or from ``first_order``, one apart). One that the catalog has stays as it is. Of several
    rows for a new one, the least of each attribute counts; tokens are trimmed and lower-cased."""
    given = set(names.columns)
    attributes = {n: (F.col(n) if n in given else F.lit(None)).cast("string") for n in ("external_id", "parent_name")}
    tokens = F.col("filename_tokens") if "filename_tokens" in given else F.lit(None)
    tokens = F.filter(F.transform(tokens.cast("array<string>"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    new = (
        names.select(base_org(F.col("org")).alias("name"), *[blank_to_null(c).alias(n) for n, c in attributes.items()], tokens.alias("filename_tokens"))
        .where(F.col("name") != "Unknown")
        .groupBy("name").agg(*[F.min(n).alias(n) for n in ("external_id", "parent_name")], F.min(F.when(F.size("filename_tokens") > 0, F.col("filename_tokens"))).alias("filename_tokens"))
        .join(catalog.select("name"), "name", "left_anti")
    )
    nth = F.col("_nth")
    if first_order is None:
        top = catalog.agg(F.coalesce(F.max("sort_order"), F.lit(0))).scalar()
        order = (top + nth * 10 + 10).cast("int")
    else:
        order = (nth + F.lit(first_order)).cast("int")
    added = numbered(new, "name", name="_nth").withColumn("sort_order", order).drop("_nth")
    return catalog.unionByName(added)


def add_mappings(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    """Catalog plus organizations for external ids of one's own (org_id, org_name)."""
    return ensure_organizations(catalog, mappings.select(F.col("org_name").alias("org"), F.col("org_id").cast("string").alias("external_id")))


def compact(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def bulk_file_name(name: Column) -> Column:
    """Whether a compact file name looks like a bulk export."""
    return name.contains("massingest") | (name.endswith("mi") & (F.length(name) > 2))


def file_name_orgs(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``org`` to files (file_name, log_type) from the longest catalog token in the name, as
    the bulk twin for bulk files; without a match the first option of the file's kind.

    All tokens travel as one array value, since the catalog is a short list of organizations."""
    tokens = catalog.select("name", "sort_order", F.explode("filename_tokens").alias("token")).select(
        "name", "sort_order", compact(F.col("token")).alias("token")
    ).where(F.col("token") != "")
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.length("token")).alias("minus"), F.col("sort_order").alias("nth"), "token", "name"))
    )
    patterns = tokens.agg(ranked).scalar()
    first = catalog.agg(F.min(F.struct("sort_order", "name"))["name"]).scalar()
    name = compact(F.col("file_name"))
    bulk = (F.coalesce(F.col("log_type"), F.lit("")) == BULK) | bulk_file_name(name)
    match = F.get(F.filter("_patterns", lambda p: name.contains(p["token"])), F.lit(0))["name"]
    base = F.coalesce(match, first)
    known = files.withColumn("_patterns", patterns)
    return known.withColumn("org", F.when(bulk, bulk_org(base)).otherwise(base)).drop("_patterns")


def infer_file_orgs(files: Sequence[tuple[str, str]], catalog: DataFrame, used: set[str] = frozenset()) -> dict[str, str | None]:
    """Organizations of the files (path, log type) of one delivery, in their order, by catalog tokens
    in the file name, longest token first, ties in catalog order.

    A label that another file has, or that is in ``used``, is avoided: first comes an unused match,
    then a match, then an unused label of the file's kind, then any unused label, then the first."""
    rows = catalog.select("name", "filename_tokens").orderBy("sort_order", "name").collect()  # a short list
    tokens = [(letters_only(t), r.name) for r in rows for t in r.filename_tokens or []]
    tokens.sort(key=lambda pair: -len(pair[0]))
    kinds = {True: [bulk_org_name(r.name) for r in rows], False: [r.name for r in rows]}
    options = [label for pair in zip(kinds[False], kinds[True], strict=True) for label in pair]
    taken, out = set(used), {}
    for path, log_type in files:
        base = path.replace("\\", "/").rsplit("/", 1)[-1]
        name = letters_only(base)
        stem = letters_only(base.rsplit(".", 1)[0])
        bulk = log_type == BULK or "massingest" in name or (stem.endswith("mi") and len(stem) > 2)
        matches = [bulk_org_name(org) if bulk else org for token, org in tokens if token and token in name]
        choices = [*[m for m in matches if m not in taken], *matches, *[o for o in [*kinds[bulk], *options] if o not in taken], *options]
        out[path] = choices[0] if choices else None
        if choices:
            taken.add(choices[0])
    return out


def letters_only(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isalnum())


def bulk_org_name(name: str) -> str:
    return name if name.endswith(BULK_SUFFIX) else name + BULK_SUFFIX
