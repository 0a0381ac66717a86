"""Language identification, toxicity, personal data, and the pipeline."""

import collections
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimlake.llm import language, mixing, pii, toxicity
from claimlake.llm.registry import QUERIES

TONGUES = {"xa": ("ka", "lo", "mi", "ne"), "yb": ("str", "eng", "urd", "olf"), "zc": ("éa", "ôu", "îs", "ça")}


def many(prose, n=120):
    names = sorted(TONGUES)
    return [(i, prose(i, 5 + i % 60, TONGUES[names[i % 3]]).capitalize() + ".", names[i % 3], f"s{i % 5}") for i in range(n)]


def test_language_of_held_out_texts(spark, docs_of, prose, tables):
    rows = many(prose) + [(500, None, "xa"), (501, "", "xa"), (502, "123 !?", "yb"), (503, "ka lo", None), (503, "ka lo", None), (None, "str eng urd", None), (504, "漢字 only", None)]
    got = QUERIES["op4_language_id"](spark, tables(documents=docs_of(rows, extra=("Lang_Pred", "id_text")))).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in many(prose)}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in want:
            assert r["lang_pred"] == want[r["doc_id"]]
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[500] == by[501] == by[502] == "und" and by[503] == "xa" and by[None] == "yb" and by[504] != "und"


def phrases(text, sample):
    """Greedy longest matches, straight from the definition."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_cross_parsing_counts_longest_matches():
    rng = random.Random(3)
    for _ in range(30):
        sample = "".join(rng.choice("abc ") for _ in range(60)).strip()
        sample = re.sub(" +", " ", sample)
        model = language.Model({"l": sample})
        text = re.sub(" +", " ", "".join(rng.choice("abcd ") for _ in range(rng.randint(1, language.STRETCH)))).strip() or "a"
        rate = model.rates([text])[0][0]
        if any(c.isalpha() for c in text):
            assert round(rate * len(text) / model.bits[0]) == phrases(text, sample)


def test_language_edges(spark, docs_of, prose, tables):
    long = prose(1, 30_000, TONGUES["yb"])
    model = language.Model({k: prose(9, 400, v) for k, v in TONGUES.items()})
    assert language.identify(docs_of([(1, long)]), model).first()["lang_pred"] == "yb"
    assert language.Model({"a": "x y", "b": "x y"}).rates(["x"]).tolist()[0][0] >= 0
    assert language.identify(docs_of([(1, "x y")]), language.Model({"a": "x y", "b": "x y"})).first()["lang_pred"] == "a"  # a tie
    unlabelled = tables(documents=docs_of([(1, "abc", None), (2, None)]))
    assert {r["lang_pred"] for r in QUERIES["op4_language_id"](spark, unlabelled).collect()} == {"und"}
    assert QUERIES["op4_language_id"](spark, tables(documents=docs_of([]))).count() == 0


def test_toxicity_of_held_out_texts(spark, docs_of, prose, tables):
    rng, rows, labels = random.Random(1), [], []
    for i in range(900):
        words, bad = prose(i, 80).split(), i % 6 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "scab", "grub"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5000, ""), (None, "vile"), (5001, "vile " * 20_000)]
    labels += [(5, None, None), (None, 1, 1), (6, 0, 0), (7777, 1, 1)]
    folder = tables(documents=docs_of(rows, extra=("score", "Ratio")), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = QUERIES["op9_toxicity"](spark, folder).collect()
    assert len(got) == len(rows)
    right = [r["predicted"] == int(r["doc_id"] % 6 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5000}) == 1 and next(r for r in got if r["doc_id"] == 5001)["predicted"] == 1


def test_toxicity_without_labels(spark, docs_of, tables):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in QUERIES["op9_toxicity"](spark, tables(documents=docs_of([(1, "a b")]), labels=none)).collect()} == {0}
    assert QUERIES["op9_toxicity"](spark, tables(documents=docs_of([]), labels=none)).count() == 0
    same = spark.createDataFrame([(i, 1, 1) for i in range(50)], "doc_id long, quality int, toxic int")
    assert QUERIES["op9_toxicity"](spark, tables(documents=docs_of([(i, "a b") for i in range(50)]), labels=same)).count() == 50


def test_toxicity_of_pairs_of_plain_words(spark, docs_of, prose):
    rng, rows, labels = random.Random(7), [], []
    for i in range(900):
        words, bad = prose(i, 80).split(), i % 6 == 0
        for _ in range(4):
            at, apart = rng.randrange(len(words)), rng.randrange(3, 20)
            words[at:at] = ["grey", "goose"] if bad else ["grey", *words[at : at + apart], "plain", "goose"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = docs_of(rows).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = F.col("doc_id") % 5 != 0
    for hot_words in (toxicity.HOT_WORDS, 1):
        model = toxicity.fit(docs.filter(learned), known.filter(learned), hot_words)
        got = toxicity.score_documents(docs, model, ["doc_id"]).filter(~learned).collect()
        assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in got) >= 0.98 * len(got)


def test_pair_ratios_are_those_of_the_two_levels(docs_of):
    rows = [("a b", 1)] * 9 + [("a c", 1)] * 2 + [("b c", 1)] + [(f"{x} b a c", 0) for x in "cde"] * 40 + [("c a d", 0)] * 8
    share = 12 / len(rows)
    counts = toxicity.class_counts(docs_of([(i, t) for i, (t, _) in enumerate(rows)]).select("text", F.when(F.col("doc_id") < 12, 1).otherwise(0).alias("toxic")), share)
    ratios = toxicity.log_ratios(counts, toxic_share=share)
    seen = {(k, u, w): 0 for k in (0, 1) for u in "abcde" for w in "abcde"}
    before, times = {}, {}
    for text, k in rows:
        words = text.split()
        for u, w in zip([None, *words], words):
            seen[k, u, w] = seen.get((k, u, w), 0) + 1
            times[k, w] = times.get((k, w), 0) + 1
            before.setdefault((k, w), set()).add(u)
    n = {(k, w): len(before.get((k, w), ())) for k in (0, 1) for w in "abcde"}
    pooled = {w: len(before.get((0, w), set()) | before.get((1, w), set())) for w in "abcde"}
    total = [sum(n[k, w] for w in "abcde") for k in (0, 1)]
    common = {w: pooled[w] / sum(pooled.values()) for w in "abcde"}
    cut = lambda x, expected: max(0, x - toxicity.EXCESS * expected - toxicity.DISCOUNT)
    own = {(k, w): cut(n[k, w], total[k] * common[w]) for k in (0, 1) for w in "abcde"}
    low = {(k, w): own[k, w] / total[k] + (1 - sum(own[k, x] for x in "abcde") / total[k]) * common[w] for k in (0, 1) for w in "abcde"}
    two = {(k, u, w): cut(seen[k, u, w], (1 - share, share)[k] * (seen[0, u, w] + seen[1, u, w])) for k in (0, 1) for u in "abcde" for w in "abcde"}
    assert two[1, "a", "b"] > 0

    def high(k, u, w):
        size = times.get((k, u), 0)
        return (two[k, u, w] + (size - sum(two[k, u, x] for x in "abcde")) * low[k, w]) / size if size else low[k, w]

    for text in ("a b", "a c", "d b a c", "b"):
        words = text.split()
        want = math.log(low[1, words[0]] / low[0, words[0]]) + sum(math.log(high(1, u, w) / high(0, u, w)) for u, w in zip(words, words[1:]))
        got = toxicity.mean_ratios(docs_of([(1, text)]), ratios, ["doc_id"]).first()["ratio"]
        assert abs(got * len(words) - want) < 1e-9, text


def test_counts_grow_with_contexts_not_copies(docs_of):
    rows = docs_of([(1, "a x"), (2, "a x"), (3, "b x"), (4, "a x")]).select("text", F.when(F.col("doc_id") == 4, 0).otherwise(1).alias("toxic"))
    counts = toxicity.class_counts(rows).toArrow()
    assert sorted(zip(counts["ordinary"].to_pylist(), counts["toxic"].to_pylist(), counts["pooled"].to_pylist())) == [(0, 1, 1), (1, 1, 1), (1, 2, 2)]


PLAIN = "mail bob.x@mail.example.com, +1 (988) 555-2485, 4041 8949 7460-8795, 42.144.35.254, 300.1.1.1, 1234567890123"


def test_plain_personal_data():
    found = {(k, PLAIN[a:b]) for k, a, b in pii.detect(PLAIN)}
    assert found == {("email", "bob.x@mail.example.com"), ("phone", "+1 (988) 555-2485"), ("card", "4041 8949 7460-8795"), ("ip", "42.144.35.254")}


def test_plain_rules_against_patterns():
    def wanted(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]

    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a.@-+ 01245()%_é\n") for _ in range(rng.randint(0, 40)))
        assert pii.detect(t) == wanted(t), t


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("so john [at] example [dot] com is", "email", "john [at] example [dot] com"),
    ("so jo.d at mail dot example dot com is", "email", "jo.d at mail dot example dot com"),
    ("so ｂｏｂ＠ｍａｉｌ．ｃｏｍ is", "email", "ｂｏｂ＠ｍａｉｌ．ｃｏｍ"),
    ("so bоb@mаil.com is", "email", "bоb@mаil.com"),
    ("so b​ob@mail.com is", "email", "b​ob@mail.com"),
    ("call plus one nine eight eight five five five two four eight five now", "phone", "plus one nine eight eight five five five two four eight five"),
    ("card ٤٠٤١٨٩٤٩٧٤٦٠٨٧٩٥ now", "card", "٤٠٤١٨٩٤٩٧٤٦٠٨٧٩٥"),
    ("card four one one one 1111 1111 1111 now", "card", "four one one one 1111 1111 1111"),
    ("host one nine two dot one six eight dot zero dot one now", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguises_map_back(text, kind, part):
    spans = pii.disguised(text, pii.detect(text))
    assert (kind, text.index(part), text.index(part) + len(part)) in spans


@pytest.mark.parametrize("text", ["the three five of them", "look at the dot com era", "at one point", "Ünïcödé prose, в доме", "we met at noon (at last)", "a" * 50_000, "1." * 50_000, "at " * 20_000])
def test_clean_text_stays_clean(text):
    assert pii.disguised(text, pii.detect(text)) == [] or text.startswith("1.")


def test_personal_data_edges(spark, docs_of, tables):
    rows = [(1, PLAIN), (1, PLAIN), (2, None), (3, ""), (None, "a@b.c")]
    got = QUERIES["op10_personal_data"](spark, tables(documents=docs_of(rows, extra=("Base", "pii_text")))).collect()
    assert sorted((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 1)]
    assert next(r for r in got if r["doc_id"] is None)["spans"] == "email:0:5"
    assert QUERIES["op10_personal_data"](spark, tables(documents=docs_of([]))).count() == 0


def test_pipeline(spark, docs_of, prose, tables):
    rows = many(prose, 90) + [(200, None), (201, "12 34"), (202, prose(0, 5, TONGUES["xa"]) + "."), (203, prose(4, 9, TONGUES["yb"]).upper() + "."), (7, many(prose, 8)[7][1])]
    bench = spark.createDataFrame([(1, prose(50, 20, TONGUES["zc"]))], "item_id long, text string")
    rows += [(300, prose(50, 20, TONGUES["zc"]), "zc", "s1"), (301, prose(50, 20, TONGUES["zc"]) + " " + prose(51, 600, TONGUES["zc"]), "zc", "s1")]
    df = docs_of(rows, extra=("shard", "lang_pred", "n_words", "position"))
    folder = tables(documents=df, benchmark=bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == df.columns
    kept = {r["doc_id"] for r in docs.collect()}
    assert not kept & {200, 201, 300} and 301 in kept and len(kept & {4, 203}) <= 2
    last = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in last} <= kept and set(last[0].asDict()) == {*df.columns, "slot"}
    size = sum(len((r["text"] or "").split()) for r in last)
    assert size == pytest.approx(sum(len(r["text"].split()) for r in docs.collect()), rel=0.1)
    assert sorted((r["shard"], r["slot"]) for r in last) == sorted({(r["shard"], r["slot"]) for r in last})


def test_pipeline_of_empty_tables(spark, docs_of, tables):
    folder = tables(documents=docs_of([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def five_word_components(rows):
    """(id, text) -> least id of each component of a five-word Jaccard of 0.8, by all pairs."""
    def words(text):
        w = re.findall(r"[^ \t-\r]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: words(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return set(root.values())


def test_pipeline_near_duplicates_against_all_pairs(spark, docs_of, prose):
    rows = []
    for i in range(12):
        words = prose(700 + i, 150).split()
        rows.append((20 * i, " ".join(words)))
        for j, share in enumerate((2, 12, 16, 20, 22, 24, 26, 30), 1):
            n = 150 * share // 100
            rows.append((20 * i + j, " ".join(words + prose(900 + 20 * i + j, n).split() if i % 2 else words[:-n])))
        swapped = words[:]
        swapped[10 * (i % 7) + 20] = "other"
        rows.append((20 * i + 10, " ".join(swapped)))
    rows += [(900, "ka lo mi ne"), (901, "Ka lo mi ne"), (902, "ka lo mi ne ru")]
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()]
    want = five_word_components(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows)


def test_pipeline_slots_follow_training_position(spark, docs_of, prose, tables):
    rows = [(i, prose(i, 5 + i % 40), "xa", "s0" if i % 5 else f"s{i % 3}") for i in range(300)]
    df = docs_of(rows, extra=("position", "training_position", "home"))
    mixed = tables(mix=corpus_pipeline.source_mix(spark, df, ""))
    got = corpus_pipeline.shards(spark, spark.read.parquet(f"{mixed}/mix.parquet"), "")
    assert {*got.columns} == {*df.columns, "shard", "slot"}
    got = got.collect()
    uses = mixing.mix_sources(df, mixing.word_count()).select(F.explode("positions").alias("p"), "doc_id").collect()
    assert any(a["doc_id"] == b["doc_id"] for a in uses for b in uses if a["p"] < b["p"])
    shard = {r["doc_id"]: r["shard"] for r in got}
    for s in range(corpus_pipeline.SHARDS):
        held = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == s)
        assert [n for n, _ in held] == list(range(len(held)))
        assert [d for _, d in held] == [d for _, d in sorted((u["p"], u["doc_id"]) for u in uses if shard[u["doc_id"]] == s)]


def plain_ratios(labelled):
    """word -> log P(word | toxic) - log P(word | ordinary), and that of any other word, from the definition over words themselves."""
    pairs = {0: set(), 1: set()}
    for text, toxic in labelled:
        w = re.findall("[a-z0-9]+", text.lower())
        pairs[toxic] |= set(zip(w, [None, *w]))
    counts = [collections.Counter(w for w, _ in p) for p in (pairs[0], pairs[1], pairs[0] | pairs[1])]
    total = [sum(c.values()) for c in counts]
    own = [{w: max(0, counts[k][w] - 3 * total[k] * n / total[2] - 2) / total[k] for w, n in counts[2].items()} for k in (0, 1)]
    left = [1 - sum(o.values()) for o in own]
    chance = lambda k, w: own[k][w] + left[k] * counts[2][w] / total[2]
    return {w: math.log(chance(1, w) / chance(0, w)) for w in counts[2]}, math.log(left[1] / left[0])


@pytest.mark.parametrize("hot_words", [toxicity.HOT_WORDS, 5, 0])
def test_ratios_are_those_of_whole_words(spark, docs_of, prose, hot_words):
    rng, rows = random.Random(4), []
    for i in range(400):
        words = prose(i, 20).split()
        for _ in range(4 if i % 8 == 0 else 0):
            words.insert(rng.randrange(len(words)), f"bad{rng.randrange(12)}")
        rows.append((i, " ".join(words)))
    want, other = plain_ratios([(t, int(i % 8 == 0)) for i, t in rows])
    counts = toxicity.class_counts(docs_of(rows).select("text", (F.col("doc_id") % 8 == 0).cast("int").alias("toxic")))
    ratios = toxicity.log_ratios(counts, hot_words)
    assert ratios.base == pytest.approx(other) and (ratios.rest is None) == (hot_words > 100) and sum(abs(r - other) > 1e-9 for r in want.values()) > 8
    asked = [*rows, (900, "bad1 bad1 bad2 unheard"), (901, "unheard"), (902, ""), (903, None), (903, None), (900, "bad3")]
    got = toxicity.mean_ratios(docs_of(asked, extra=("tox_row", "word", "above")), ratios, ["doc_id", "n_chars", "word", "above"]).collect()
    mean = lambda t: sum(want.get(w, other) for w in t.split()) / max(1, len(t.split()))
    said = sorted((r["doc_id"], -1 if r["n_chars"] is None else r["n_chars"], r["ratio"]) for r in got)
    assert [x[:2] for x in said] == sorted((i, -1 if t is None else len(t)) for i, t in asked)
    assert [x[2] for x in said] == pytest.approx([x[2] for x in sorted((i, -1 if t is None else len(t), mean(t or "")) for i, t in asked)])


def test_words_beyond_a_million_stay_apart(docs_of):
    n = 1_300_000
    rows = docs_of([(j, " ".join(f"w{i}" for i in range(j, n, 20))) for j in range(20)]).select("text", F.lit(0).alias("toxic"))
    assert toxicity.class_counts(rows).count() == n


@pytest.mark.parametrize(("text", "part"), [
    ("so john dot smith at example dot com is", "john dot smith at example dot com"),
    ("so a dot b dot c_d at mail dot example dot com is", "a dot b dot c_d at mail dot example dot com"),
    ("so jane at example.com.", "jane at example.com"),
    ("SO JANE AT MAIL.EXAMPLE.ORG, THEN", "JANE AT MAIL.EXAMPLE.ORG"),
    ("so john dot smith at example.zz is", "john dot smith at example.zz"),
    ("so jane at example [dot] zz is", "jane at example [dot] zz"),
    ("so john dot smith [at] example [dot] com is", "john dot smith [at] example [dot] com"),
])
def test_worded_addresses_are_whole(text, part):
    assert pii.disguised(text, pii.detect(text)) == [("email", text.index(part), text.index(part) + len(part))]


@pytest.mark.parametrize("text", [
    "look at example.com", "find us at example.com", "jane at www.example.com", "jane at example.com/team", "we met at noon.It was", "noon at home.so",
    "a dot " * 50_000, "a at b." * 50_000, "a at " * 50_000, "a at b.c.d/" * 50_000, "a dot b at " * 30_000,
])
def test_prose_with_at_stays_clean(text):
    began = time.process_time()
    assert pii.disguised(text, pii.detect(text)) == []
    assert time.process_time() - began < 5


def test_letters_of_large_scripts_are_told_apart():
    rng = random.Random(6)
    script = [chr(0x4E00 + i) for i in range(600)]
    for _ in range(20):
        samples = {k: "".join(rng.choice(script[a : a + 400] + ["a", "b", "İ", "Σ"]) for _ in range(900)) for k, a in (("l", 0), ("m", 200))}
        model = language.Model(samples)
        fold = lambda t: "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        for _ in range(5):
            cut = rng.randrange(800)
            text = "".join(samples["l"][cut : cut + 20] + "".join(rng.choice(script + ["漿", "é"]) for _ in range(30)) + samples["m"][cut : cut + 20])
            rates = model.rates([text])[0]
            assert [round(r * len(text) / b) for r, b in zip(rates, model.bits, strict=True)] == [phrases(fold(text), fold(samples[k])) for k in ("l", "m")]
