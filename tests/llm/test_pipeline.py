import random

import test_jaccard
import test_rules
import test_winnow

import corpus_pipeline
from meterlake.llm import pieces
from meterlake.llm.queries import PIECE_MODEL


def fixture():
    """(rows, labels, items): plain texts, shouted ones, ones with symbols, near copies, passages of
    the benchmark, and texts that are short, empty or null."""
    r = random.Random(11)
    words = lambda n: ["".join(r.choice("aeiounrst") for _ in range(r.randrange(3, 8))) for _ in range(n)]
    plain = [words(r.randrange(80, 140)) for _ in range(150)]
    items = [(i, " ".join(words(14))) for i in range(6)]
    rows, labels = [], []
    for i, w in enumerate(plain):
        bad = i % 5 == 1
        if i % 17 == 3:
            w = w[:40] + items[i % 6][1].split() + w[40:]
        rows.append((i, " ".join(w).upper() + "." if bad else " ".join(w) + "."))
        labels.append((i, 0 if bad else 1, 0))
    for i in range(0, 40, 4):  # near copies, the least id among them last or first
        w = list(plain[i])
        w[9] = f"other{i}"
        rows.append((1000 + i, " ".join(w) + "."))
        rows.append((-1 - i, rows[i][1]))
    rows += [(2000 + i, " ".join(x + "***" for x in words(90))) for i in range(4)]
    rows += [(3000, None), (3001, ""), (3002, "few words"), (3003, "x " * 80), (7, rows[7][1])]
    return rows, labels, items


def test_stages_equal_brute_force(spark, documents, tmp_path):
    rows, labels, items = fixture()
    docs = documents(rows).selectExpr("*", "doc_id AS row", "'x' AS grp", "false AS kept")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [(d, t) for d, t in rows if not test_rules.brute(t)[-1] and "***" not in t]
    calm = [(d, t) for d, t in good if t != t.upper()]
    own = {name: group for name, _, group, _ in test_jaccard.brute(calm, 5, 80)}
    first = sorted({d: t for d, t in calm if own[repr(d)] == d}.items())
    leaks = {name for name, *_, hit in test_winnow.brute(first, items) if hit}
    clean = [(d, t) for d, t in first if repr(d) not in leaks]
    assert len(rows) > len(good) > len(calm) > len(first) > len(clean) > 50

    left = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], [good, calm, first, clean], strict=True):
        left = corpus_pipeline.kept(stage(spark, left, str(tmp_path)), "test-stage")
        assert left.columns == docs.columns
        assert sorted((x.doc_id, x.text) for x in left.collect()) == sorted(want)
    out = corpus_pipeline.run(spark, str(tmp_path))
    back = pieces.decode_documents(out, PIECE_MODEL).collect()
    assert sorted((x.doc_id, x.text) for x in back) == clean


def test_classifier_stage_learns_from_the_whole_table(spark, documents, tmp_path):
    """A stage whose input has good labelled rows only still rejects an unlabelled bad one."""
    rows, labels, _ = fixture()
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [(d, t) for d, t in rows if t and t != t.upper()] + [(5000, rows[1][1].replace(" A", " O"))]
    got = corpus_pipeline.quality_classifier(spark, documents(left), str(tmp_path))
    assert 5000 not in {x.doc_id for x in got.collect()}
