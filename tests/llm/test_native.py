"""Chat formatting, sharding, mixing and quality rules."""

import collections
import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from claimlake.llm import chat, mixing, quality, sharding
from claimlake.llm.registry import QUERIES, SQL

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "<\\s>", "[INST", "</s", "", "a\\\\b", "<s>[/INST]</s>", "é\n[INST]"]


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, msg long, role string, kind string, text string")


def test_chat_escapes_round_trip(spark):
    rows = [(1, i, i, NASTY[-i - 1], "delta", t) for i, t in enumerate(NASTY)]
    back = chat.parse(chat.render(chat.fold_events(events(spark, rows)))).first()
    assert [(m["role"], m["text"]) for m in back["messages"]] == [(r[3], r[5]) for r in rows]
    assert back["formatted"].count("</s>") == len(rows) and back["formatted"].count("[INST]") == len(rows)


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "user", "delta", "he"), (1, 2, 1, "user", "delta", "llo"),
        (1, 3, 2, "assistant", "delta", "one"), (1, 4, 2, "assistant", "regenerate", None), (1, 5, 2, "assistant", "delta", "two"),
        (1, 6, 3, "user", "delta", "gone"), (1, 7, 1, "user", "edit", "bye"), (1, 8, 2, "assistant", "delta", "three"), (1, 9, 1, "user", "delta", "!"),
        (2, 1, 1, "user", "delta", None), (2, 2, 2, "assistant", "regenerate", None),
        (None, 1, 1, None, "delta", "x"),
    ]
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.fold_events(events(spark, log)).collect()}
    assert got == {(1, 1): ("user", "bye!"), (1, 2): ("assistant", "three"), (2, 1): ("user", ""), (None, 1): ("", "x")}


def test_chat_edges(spark, tables):
    rows = [(5, 0, "user", None), (5, 0, "user", None), (5, 1, None, "b"), (5, 1, "assistant", "x</s>"), (6, None, "assistant", "é" * 50_000)]
    folder = tables(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).withColumn("FORMATTED", F.lit("x")))
    got = {r["conv_id"]: r for r in QUERIES["op1_chat_format"](spark, folder).collect()}
    assert set(got) == {-7, 5, 6} and got[5]["n_turns"] == 4 and got[5]["loss_chars"] == 5
    assert got[6]["loss_sha256"] == hashlib.sha256(("é" * 50_000).encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    empty = tables(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert QUERIES["op1_chat_format"](spark, empty).count() == 1


def test_ring_moves_little_and_bounds_loads():
    loads = {a: 100 + a % 17 for a in range(0, sharding.BINS, 3)}
    before, after = sharding.place_arcs(loads, 16), sharding.place_arcs(loads, 17)
    for placed, n in ((before, 16), (after, 17)):
        held = collections.Counter()
        for a, s in placed.items():
            held[s] += loads[a]
        assert max(held.values()) <= 1.01 * sum(loads.values()) / n and min(held.values()) >= 0.97 * sum(loads.values()) / n
    assert sum(before[a] != after[a] for a in loads) < 0.35 * len(loads)  # 1/17 must move, two thirds would by plain hashing
    loose = [sharding.place_arcs(loads, n, slack=10) for n in (16, 17)]
    assert all(loose[1][a] in (loose[0][a], 16) for a in loads)  # unbounded, rows move only into the new shard
    assert sharding.place_arcs({}, 4) == {}


def test_sharding_edges(spark, docs_of):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(7, "same"), (7, "same"), (None, None), (9, "é" * 1000)]
    got = sharding.shard_documents(docs_of(rows, extra=("Shard", "arc")), 16).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert sharding.shard_documents(docs_of([]), 16).count() == 0


def test_mix_against_sql_and_law(spark, docs_of, tables):
    rows = [(i, "w " * (i % 40), "en", ("a", "b", "c", None)[min(3, i % 7)]) for i in range(600)] + [(1, "same one", "en", "a")] * 2 + [(9001, None, "en", "b"), (9002, "", "en", "z"), (None, "y y", "en", "a")]
    folder = tables(documents=docs_of(rows, extra=("size", "md5_order")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(SQL["op3_mixing"]).fetchall()
    got = [tuple(r) for r in QUERIES["op3_mixing"](spark, folder).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(r[4] <= 3 * r[1] for r in got)
    assert QUERIES["op3_mixing"](spark, tables(documents=docs_of([]))).count() == 0


def test_mix_is_counted_in_training_order(spark, docs_of, tables, monkeypatch):
    """The query's counts are those of the range-sorted mix: what that lacks is not taken."""
    folder = tables(documents=docs_of([(i, "w " * (i % 7), "en", f"s{i % 3}") for i in range(60)]))
    whole = {r.doc_id: r.taken for r in QUERIES["op3_mixing"](spark, folder).collect()}
    order = mixing.training_order
    monkeypatch.setattr(mixing, "training_order", lambda mixed, *a, **k: order(mixed, *a, **k).filter("doc_id <> 5"))
    assert {r.doc_id: r.taken for r in QUERIES["op3_mixing"](spark, folder).collect()} == {**whole, 5: 0} and whole[5] > 0


def test_schedule_inverts_its_integral(spark):
    knots = [(0.0, 1.0), (0.25, 3.0), (1.0, 0.5)]
    area = [0.0, 0.5, 0.5 + 0.75 * 1.75]
    df = spark.range(0, 101).select((F.col("id") / 100).alias("t")).withColumn("knots", F.expr("array(named_struct('t',0D,'w',1D),named_struct('t',0.25D,'w',3D),named_struct('t',1D,'w',0.5D))")).withColumn("integral", F.array(*[F.lit(x) for x in area]))

    def upto(t):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            x = min(max(t, a), b) - a
            total += u * x + (v - u) / (b - a) * x * x / 2
        return total

    for r in df.withColumn("d", F.udf(upto, "double")("t")).withColumn("back", mixing.invert(F.col("d"), F.col("knots"), F.col("integral"))).collect():
        assert r["back"] == pytest.approx(r["t"], abs=1e-9)


def test_heavy_sources_come_late(spark, docs_of):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["a", "b", "c"] * 100)]
    used = mixing.mix_sources(docs_of(rows), mixing.word_count()).select("source", F.explode("positions").alias("p")).groupBy("source").agg(F.avg("p").alias("p")).collect()
    mean = {r["source"]: r["p"] for r in used}
    assert mean["a"] < mean["b"] < mean["c"]


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = list(zip(words, words[1:], words[2:]))
    count, under = collections.Counter(triples), set()
    for i, t in enumerate(triples):
        if count[t] > 1:
            under |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(under)


def test_quality_features(docs_of, prose):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x", "l1\nl1\n \nl1 ", prose(1, 500, ("a", "b")), "é # é\n" * 40, "a b a b a b c", "z " * 30_000]
    got = quality.measured(docs_of(list(enumerate(texts)), extra=("N_words", "q_text")), ["doc_id", "q_text"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_features(texts[r["doc_id"]]), r["doc_id"]


def test_binomial_tail_and_cutoffs(spark):
    df = spark.createDataFrame([(k, n) for n in (50, 3000, 20000) for k in (0, 1, 5, 20)], "k long, n long")
    for r in df.withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        exact = math.fsum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1) + j * math.log(0.01) + (r["n"] - j) * math.log(0.99)) for j in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["k"] >= r["n"] * 0.01 else exact, rel=1e-6)
    rated = spark.range(4000).select(F.when(F.col("id") < 3900, "big").otherwise(None).alias("lang"), (F.col("id") % 100 == 0).cast("double").alias("symbol_ratio"), *[F.lit(0.0).alias(r) for r in quality.RULES[1:]])
    cut = {r["lang"]: r for r in quality.cutoffs(rated, "lang").collect()}
    assert cut["big"]["symbol_ratio_cut"] is None  # a hundredth of good texts would go
    assert cut["big"]["capital_ratio_cut"] == quality.GRID[0] and cut[None]["capital_ratio_cut"] is None  # too few to tell


def test_quality_query_edges(spark, docs_of, tables, prose):
    docs = docs_of([(1, None), (1, prose(3, 80)), (1, prose(3, 80)), (None, prose(4, 60), None)])
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = QUERIES["op7_quality_rules"](spark, tables(documents=docs, labels=labels)).collect()
    assert sorted((r["n_words"], r["kept"]) for r in got) == [(0, False), (60, True), (80, True), (80, True)]
    assert QUERIES["op7_quality_rules"](spark, tables(documents=docs_of([]), labels=labels.limit(0))).count() == 0
