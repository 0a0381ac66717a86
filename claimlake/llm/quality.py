"""Quality rules with risk-controlled thresholds.

Each rule is a ratio of a text; texts above its cutoff are rejected. For every stratum and every cutoff of a fixed grid, the
good texts of the labelled holdout that the cutoff would reject are counted. A cutoff may be used only if the exact
binomial tail shows, over all tests together (Bonferroni) with confidence 1 - delta, that the rule rejects at most its share of
alpha of the stratum's good texts. The lowest such cutoff is taken; where none passes, the rule rejects nothing there.

All of it is DataFrame functions. Holdout counts are conditional sums, one row for each stratum.

Nulls: a null text has no words, a null stratum is a stratum, null labels and ids are not learned from. An id with several
labels is good if all say so. Empty texts fail the base rules. Repeated rows get equal verdicts. Empty tables give empty results
or no cutoffs. Columns of the output's names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlake.functions.stage import sealed
from claimlake.llm.common import WORD, fresh, quoted

ALPHA, DELTA = 0.02, 0.05
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9)
RULES = ("symbol_ratio", "capital_ratio", "dup_line_ratio", "repeat_ratio")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")


def measured(df: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with FEATURES of the whole text (all long)."""
    text, words, hashes, triples, ordered, places = fresh(df, "q_text", "q_words", "q_hashes", "q_triples", "q_ordered", "q_places")
    kept = [quoted(c) for c in keep if c.lower() not in FEATURES]
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD))
    split = sealed(df.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias(text))).select(
        *kept, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias(words), lines.alias("q_lines"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    counted = sealed(split).select(
        *kept, "n_symbols", "n_capitals", F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.size("q_lines").cast("long").alias("n_lines"), (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias(hashes),
    )
    at = lambda i: F.get(F.col(hashes), i)
    base = [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_capitals", "n_lines"]
    windows = F.when(F.size(hashes) >= 3, F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    tripled = sealed(sealed(counted).select(*base, windows.alias(triples)))
    # equal windows stand together once sorted; only texts that have any are sorted
    struct = F.array().cast("array<struct<h:bigint,i:int>>")
    sort = F.when(F.size(F.array_distinct(triples)) < F.size(triples), F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))).otherwise(struct)
    sorted_ = sealed(tripled.select(*base, sort.alias(ordered)))
    next_ = lambda i: F.get(F.col(ordered), i)["h"]
    again = F.filter(ordered, lambda x, i: x["h"].eqNullSafe(next_(i - 1)) | x["h"].eqNullSafe(next_(i + 1)))
    found = sealed(sorted_.select(*base, F.sort_array(F.transform(again, lambda x: x["i"])).alias(places)))
    gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col(places), i + 1) - p, F.lit(3))))
    return found.select(*base, F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g).alias("n_repeat_words"))


def ratios(df: DataFrame) -> DataFrame:
    """df of FEATURES with one column for each rule and base_failed."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return (
        df.withColumn("symbol_ratio", share("n_symbols", "word_chars")).withColumn("capital_ratio", share("n_capitals", "word_chars"))
        .withColumn("dup_line_ratio", share("n_dup_lines", "n_lines")).withColumn("repeat_ratio", share("n_repeat_words", "n_words"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed term by term in logarithms; 1 from the mean on."""
    step = lambda a, j: F.struct(
        (a["p"] + F.exp(a["l"])).alias("p"), (a["l"] + F.log((n - j).cast("double") / (j + 1)) + F.lit(math.log(rate / (1 - rate)))).alias("l"),
    )
    start = F.struct(F.lit(0.0).alias("p"), (n * F.lit(math.log1p(-rate))).alias("l"))
    return F.when(k >= n * F.lit(rate), F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step, lambda a: a["p"]))


def cutoffs(holdout: DataFrame, stratum: str, *, alpha: float = ALPHA, delta: float = DELTA, grid: tuple[float, ...] = GRID) -> DataFrame:
    """holdout: good texts with ratios. stratum -> one cutoff column for each rule, null where none may be used."""
    counts = holdout.groupBy(stratum).agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(grid)])
    tested = counts.withColumn("level", F.lit(delta) / (F.count("*").over(W.partitionBy()) * len(RULES) * len(grid)))  # a row for each stratum
    lowest = lambda r: F.array_min(F.array(*[F.when(binomial_tail(F.col(f"{r}_{i}"), F.col("n"), alpha / len(RULES)) <= F.col("level"), F.lit(c)) for i, c in enumerate(grid)]))
    return tested.select(quoted(stratum), *[lowest(r).alias(f"{r}_cut") for r in RULES])


def judge(features: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """features (doc_id, stratum, FEATURES) with base_failed and kept. labels (doc_id, quality) hold the holdout."""
    rated = ratios(features)
    good = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter(F.col("q") > 0).select("doc_id")
    limits = cutoffs(rated.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi"), stratum, **options).withColumnRenamed(stratum, "q_stratum")
    passed = ~F.col("base_failed")
    for r in RULES:
        passed = passed & F.coalesce(F.col(r) <= F.col(f"{r}_cut"), F.lit(True))
    return rated.join(limits, quoted(stratum).eqNullSafe(F.col("q_stratum")), "left").select(*[quoted(c) for c in features.columns], "base_failed", passed.alias("kept"))
