"""The whole pipeline row for row against the five stages in plain Python."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import xxhash
from pyspark.sql import types as T

from claimlake.llm.registry import QUERIES

SHARDS, BINS, VNODES = 16, 8192, 64


def has_letter(text):
    return text is not None and any(c.isalpha() for c in text)


def one_of_each(rows):
    """Least id of each component of a five-word Jaccard of 0.8, by all pairs."""
    def shingles(text):
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, least = [shingles(r["text"]) for r in rows], [r["doc_id"] for r in rows]
    moved = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in links:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                moved = True
    return [r for r, low in zip(rows, least) if r["doc_id"] == low]


def clean(rows, items):
    """Rows of which less than a twentieth of the words stands in a window of 13 words of an item."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for item in items:
        w = words(item)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    kept = []
    for r in rows:
        w, hit = words(r["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    return kept


def mixed(rows):
    """(position, row) of every use: 100 % of the words by weights 1, 2, 3, no source beyond three times itself, weights moving by half around 2."""
    size = {id(r): len(re.findall(r"[^ \t-\r]+", r["text"])) for r in rows}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    held = {s: sum(size[id(r)] for r in by_source[s]) for s in names}
    target, open_, rest = {}, set(names), float(sum(held.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * held[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * held[s]
            rest -= target[s]
        open_ -= over
    out = []
    for s in names:
        start, end = weight[s] * (1 - (weight[s] - 2) * 0.5), weight[s] * (1 + (weight[s] - 2) * 0.5)
        at = 0
        for r in sorted(by_source[s], key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            n = size[id(r)]
            whole = int(target[s] // held[s])
            uses = whole + (2 * at + n <= 2 * (target[s] - whole * held[s])) if n else 0
            for use in range(uses):
                need = (use * held[s] + at + n / 2) / target[s] * weight[s]
                low, high = 0.0, 1.0
                for _ in range(80):  # the integral of a weight that moves linearly, inverted by halving
                    t = (low + high) / 2
                    low, high = (t, high) if start * t + (end - start) * t * t / 2 < need else (low, t)
                out.append(((low + high) / 2, r))
            at += n
    return out


def arc_of(doc_id):
    """The arc of an id: Spark's 64-bit hash, which leaves its seed for a null."""
    h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % BINS


def homes(load):
    """Shard of each arc: largest first, to the next virtual node clockwise whose shard has room."""
    ring = sorted((int.from_bytes(hashlib.sha256(f"{s}#{v}".encode()).digest()[:8], "big") % BINS, s) for s in range(SHARDS) for v in range(VNODES))
    bound, held, home = -(-sum(load.values()) // SHARDS) * 1.001, [0] * SHARDS, {}
    for a, n in sorted(load.items(), key=lambda x: (-x[1], x[0])):
        clockwise = [s for p, s in ring if p >= a] + [s for p, s in ring if p < a]
        shard = next((s for s in clockwise if held[s] + n <= bound), None)
        home[a] = shard = min(range(SHARDS), key=lambda s: (held[s], s)) if shard is None else shard
        held[shard] += n
    return home


def dealt(uses):
    """(doc_id, shard, slot), slots along the training position."""
    load = Counter()
    for _, r in uses:
        load[arc_of(r["doc_id"])] += len(r["text"].encode()) + 1
    home, out, filled = homes(load), [], Counter()
    for _, r in sorted(uses, key=lambda u: (u[0], u[1]["doc_id"])):
        shard = home[arc_of(r["doc_id"])]
        out.append((r["doc_id"], shard, filled[shard]))
        filled[shard] += 1
    return sorted(out)


def test_sharding_against_a_plain_ring(spark, docs_of, prose, tables):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.choice([1, 20, 300]))) for i in range(400)] + [(7, "again"), (7, "again"), (-5, "é" * 40), (401, None), (402, ""), (None, "no id"), (500, prose(9, 9000))]
    got = QUERIES["op2_sharding"](spark, tables(documents=docs_of(rows))).select("doc_id", "shard", "slot").collect()
    load, arcs = Counter(), defaultdict(list)
    for i, text in rows:
        load[arc_of(i)] += len((text or "").encode()) + 1
        arcs[arc_of(i)].append(i)
    home, want, filled = homes(load), [], Counter()
    for a in sorted(arcs):
        for i in sorted(arcs[a], key=lambda x: (x is not None, x or 0)):
            want.append((i, home[a], filled[home[a]]))
            filled[home[a]] += 1
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert [tuple(r) for r in got if r["doc_id"] is None] == [w for w in want if w[0] is None]


@pytest.mark.parametrize("extra", [(), ("shard", "Slot", "lang_pred", "n_words", "training_position", "row_name")])
def test_run_against_plain_stages(spark, docs_of, prose, tables, extra):
    rng = random.Random(5)
    passage = prose(900, 30)
    rows = []
    for i in range(70):
        text = prose(i, rng.choice([4, 30, 80, 200]))
        rows.append([i * 3, text, "en", ["a", "b", "é", None][min(3, i % 7 // 2)]])
        if i % 9 == 0:  # copies, near copies and texts just below the similarity
            rows += [[1000 + i, text, "en", "b"], [2000 + i, text.upper() + "\n", "en", "a"], [3000 + i, text + " " + prose(500 + i, len(text.split()) // 6), "en", "é"], [4000 + i, text + " " + prose(600 + i, len(text.split()) // 3), "en", "a"]]
        if i % 11 == 0:  # a passage that fills much or little of a text
            rows += [[5000 + i, prose(700 + i, 10) + " " + passage, "en", "a"], [6000 + i, prose(800 + i, 900) + ", " + passage[: len(passage) // 2], "en", "b"]]
    rows += [[7000, None, "en", "a"], [7001, "", "en", "b"], [7002, "12 34 .", None, "a"], [7003, "ab", "en", None], [7004, passage, "en", "a"]]
    items = [passage, prose(901, 5), None, ""]
    folder = tables(documents=docs_of([tuple(r) for r in rows], extra=extra), benchmark=spark.createDataFrame(list(enumerate(items)), T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])))
    docs = [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in rows]
    left = clean(one_of_each([r for r in docs if has_letter(r["text"])]), items)
    uses = mixed(left)
    got = corpus_pipeline.run(spark, folder)
    found = got.select("doc_id", "shard", "slot", "text", "source").collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in found) == dealt(uses)
    whole = {r["doc_id"]: (r["text"], r["source"]) for r in docs}
    assert all(whole[r["doc_id"]] == (r["text"], r["source"]) for r in found)
    assert 0 < len(left) < len(docs) and max(Counter(r["doc_id"] for _, r in uses).values()) > 1
    assert {c.lower() for c in got.columns} == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", *(e.lower() for e in extra)}
