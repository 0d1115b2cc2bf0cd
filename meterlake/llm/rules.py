"""Quality rules: counts of a text, fixed limits, and robust multivariate outliers.

The outlier rule fits a minimum-covariance-determinant estimate for each language and source to
transformed ratios of the counts. Every step is a projection or a grouped sum, so a source of any
size is pre-aggregated before its rows are shuffled. The half of the rows that is nearest to a
centre is found by summing moments per distance bin and adding up the bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.store import kept

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Statistic: deviations below this count as noise, so that a statistic that is constant among
#: good documents does not turn every other value into an outlier.
FLOORS = {"x_length": 0.12, "x_symbols": 0.05, "x_lines": 0.2, "x_repeats": 0.2}
DIMS = list(FLOORS)
#: Groups of fewer rows are pooled by language, and languages of fewer rows together.
MIN_GROUP = 30
#: Quantiles of chi-square with 4 degrees of freedom: 0.999 to reject, 0.975 to reweight; and the
#: factors that make the covariance of the nearest half and of the nearest 0.975 consistent.
REJECT = 18.467
REWEIGHT = 11.143
HALF_FACTOR = 2.139
REWEIGHT_FACTOR = 1.08
STEPS = 4
#: Repeated runs of a text that are looked up one by one.
SHORT_LIST = 48
#: Bins for each doubling of the squared distance.
BINS = 16


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are what white space separates; a null text has none. n_repeat_words counts the words
    inside any run of three words that the text has twice."""
    plain = F.coalesce(F.col(text), F.lit(""))
    spaced = F.translate(plain, "\t\n\x0b\x0c\r", "     ")
    lines = F.filter(F.split(plain, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    out = docs.withColumns({"_words": F.array_remove(F.split(spaced, " ", -1), ""), "_lines": lines})
    starts = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_starts", starts).withColumn("_hashes", F.transform(
        "_starts", lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    ))
    out = out.withColumn("_sorted", F.sort_array("_hashes"))
    out = out.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, k: F.get("_sorted", k + 1) == h)))
    # starts of the runs that the text has twice: looked up in a short list, or else by sorting
    # hashes with their starts, which is slower but grows with n log n
    pairs = F.sort_array(F.transform("_starts", lambda i: F.struct(F.get("_hashes", i).alias("h"), i.alias("i"))))
    out = out.withColumn("_pairs", F.when(F.size("_twice") > SHORT_LIST, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    by_sorting = F.filter("_pairs", lambda r, k: (F.get("_sorted", k - 1) == r["h"]) | (F.get("_sorted", k + 1) == r["h"]))
    out = out.withColumn("_places", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(
        F.size("_twice") <= SHORT_LIST, F.filter("_starts", lambda i: F.array_contains("_twice", F.get("_hashes", i)))
    ).otherwise(F.sort_array(F.transform(by_sorting, lambda r: r["i"]))))
    repeated = F.aggregate(
        "_places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    counted = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(plain, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_repeat_words": repeated,
    }).drop("_words", "_lines", "_starts", "_hashes", "_sorted", "_twice", "_pairs", "_places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def with_statistics(counted: DataFrame) -> DataFrame:
    """Adds the transformed ratios: logarithm of the mean word length, square roots of the shares
    of symbols, of repeated lines and of repeated words."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.lit(1), F.col(b)))
    return counted.withColumns({
        "x_length": F.log(F.greatest(F.lit(1), F.col("word_chars")) / F.greatest(F.lit(1), F.col("n_words"))),
        "x_symbols": share("n_symbols", "word_chars"), "x_lines": share("n_dup_lines", "n_lines"), "x_repeats": share("n_repeat_words", "n_words"),
    })


def _pairs() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]


def _moments() -> list[Column]:
    return [
        F.count("*").cast("double").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in DIMS],
        *[F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in _pairs()],
    ]


def _cholesky(moments: DataFrame, factor: float) -> DataFrame:
    """Centre m_* and the inverse of the covariance's lower factor, as columns."""
    out = moments.select("grp", *[(F.col(f"s_{a}") / F.col("n")).alias(f"m_{a}") for a in DIMS], *[
        (F.greatest(F.lit(0.0), factor * (F.col(f"q_{a}_{b}") / F.col("n") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n") / F.col("n"))) + F.lit(FLOORS[a] ** 2)
         if a == b else factor * (F.col(f"q_{a}_{b}") / F.col("n") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n") / F.col("n"))).alias(f"c_{a}_{b}")
        for a, b in _pairs()
    ])
    for j, b in enumerate(DIMS):  # column by column of the factor
        inner = lambda a: reduce(lambda x, d: x - F.col(f"l_{a}_{d}") * F.col(f"l_{b}_{d}"), DIMS[:j], F.col(f"c_{a}_{b}"))  # noqa: B023, E731
        out = out.withColumn(f"l_{b}_{b}", F.sqrt(F.greatest(inner(b), F.lit(FLOORS[b] ** 2 / 4))))
        out = out.withColumns({f"l_{a}_{b}": inner(a) / F.col(f"l_{b}_{b}") for a in DIMS[j + 1 :]}) if j + 1 < len(DIMS) else out
    return out.select("grp", *[f"m_{a}" for a in DIMS], *[f"l_{a}_{b}" for a, b in _pairs()])


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i, a in enumerate(DIMS):
        rest = reduce(lambda x, b: x - F.col(f"l_{a}_{b}") * F.col(f"z_{b}"), DIMS[:i], F.col(a) - F.col(f"m_{a}"))  # noqa: B023
        df = df.withColumn(f"z_{a}", rest / F.col(f"l_{a}_{a}"))
    return df.withColumn("d2", reduce(lambda x, y: x + y, [F.col(f"z_{a}") * F.col(f"z_{a}") for a in DIMS]))


def _group_names(rows: DataFrame) -> DataFrame:
    """(lang, source, grp): the group whose estimate judges the rows of a language and source."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("rows")).withColumn("small", F.col("rows") < MIN_GROUP)
    pool = sizes.where("small").groupBy(F.col("lang").alias("_pooled")).agg(F.sum("rows").alias("pool"))
    named = sizes.join(pool, F.col("lang").eqNullSafe(F.col("_pooled")), "left")
    name = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    return named.select("lang", "source", F.when(~F.col("small"), name).when(F.col("pool") >= MIN_GROUP, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})).otherwise("").alias("grp"))


def outlier_estimates(counted: DataFrame) -> DataFrame:
    """(lang, source, m_*, l_*): the robust estimate for every language and source of rows that
    have the counts and statistics; rows that failed the fixed limits do not take part."""
    columns = ["lang", "source", *DIMS]
    rows = counted.where("not base_failed").select(*columns)
    names = kept(_group_names(rows), "rules-groups")
    rows = kept(rows.join(names.withColumnsRenamed({"lang": "_l", "source": "_s"}), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).select("grp", *DIMS), "rules-rows")
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    centre = kept(rows.groupBy("grp").agg(*[median(a).alias(f"m_{a}") for a in DIMS]), "rules-centres")  # few rows of a known size: the hot group is not shuffled
    spread = rows.join(centre, "grp").groupBy("grp").agg(*[F.first(f"m_{a}").alias(f"m_{a}") for a in DIMS], *[median(F.abs(F.col(a) - F.col(f"m_{a}"))).alias(f"d_{a}") for a in DIMS])
    estimate = spread.select("grp", *[f"m_{a}" for a in DIMS], *[
        (F.sqrt((1.4826 * F.col(f"d_{a}")) ** 2 + FLOORS[a] ** 2) if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for a, b in _pairs()
    ])
    totals = kept(rows.groupBy("grp").agg(F.count("*").alias("total")), "rules-totals")
    for _ in range(STEPS):
        binned = _distance(rows.join(kept(estimate, "rules-step"), "grp")).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS).cast("int"))
        bins = binned.groupBy("grp", "bin").agg(*_moments()).join(totals, "grp")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        nearest = bins.withColumn("before", before).where(F.col("before") < F.ceil(F.col("total") / 2))
        names_ = [f"s_{a}" for a in DIMS] + [f"q_{a}_{b}" for a, b in _pairs()]
        estimate = _cholesky(nearest.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names_]), HALF_FACTOR)
    near = _distance(rows.join(kept(estimate, "rules-step"), "grp")).where(F.col("d2") <= REWEIGHT)
    reweighted = _cholesky(near.groupBy("grp").agg(*_moments()), REWEIGHT_FACTOR)
    return kept(names.join(reweighted, "grp").drop("grp"), "rules-estimates")


def judged(docs: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows that have the counts and statistics, with `distance` and `kept`. A row that failed the
    fixed limits is not kept; one whose language and source have no estimate is."""
    e = estimates.withColumnsRenamed({"lang": "_l", "source": "_s"})
    joined = _distance(docs.join(e, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left"))
    names = ["_l", "_s", *[f"m_{a}" for a in DIMS], *[f"l_{a}_{b}" for a, b in _pairs()], *[f"z_{a}" for a in DIMS]]
    return joined.drop(*names).withColumnRenamed("d2", "distance").withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance") <= REJECT, F.lit(True)))
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    the distance, for every row of (doc_id, text, lang, source).

    Null and empty texts have no words and fail. Null languages and sources are groups of their
    own; repeated rows count each; groups under MIN_GROUP rows are pooled. Other columns are ignored."""
    counted = kept(with_statistics(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text")), "rules-counts")
    out = judged(counted, outlier_estimates(counted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. The counts are made once and
    written beside the rows; the estimates read the counts only, and no text is shuffled."""
    columns = docs.columns
    held = with_statistics(with_counts(docs.select(F.struct(*columns).alias("row"), "lang", "source", "text"))).drop("text")
    counted = kept(held, "rules-counts")
    return judged(counted, outlier_estimates(counted)).where("kept").select("row.*")
