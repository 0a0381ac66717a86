"""Similarity join, decontamination and repeated text, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from claimlake.llm import decontaminate, kernel, ngram_join, repeats
from claimlake.llm.common import prefilter
from claimlake.llm.graph import components
from claimlake.llm.registry import QUERIES

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(rows, num=90, den=100):
    """Smallest id reachable of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), d if not sets[i] else min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def near_copies(prose):
    rng, rows = random.Random(5), []
    passage = prose(99, 40)
    for g in range(12):
        base = prose(g, rng.choice([3, 12, 40, 120, 300])).split()
        for c in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            text = " ".join(words)
            rows.append((len(rows), text.upper() if c % 5 == 4 else f"{passage} {text}" if c % 7 == 6 else text))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n"), (len(rows) + 3, "one"), (len(rows) + 4, "ONE"), (len(rows) + 5, "one two"), (3, rows[3][1]), (3, "another text under id 3 of its own"), (None, rows[0][1]), (None, "null id alone here")]
    return rows


@pytest.mark.parametrize("block", [1 << 21, 900])
def test_similar_documents(docs_of, prose, block):
    rows = near_copies(prose)
    got = ngram_join.similar_documents(docs_of(rows, extra=("cls", "N")), block_shingles=block).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["doc_id"], r["n"], r["component_id"]) for r in got], key=key) == sorted(classes(rows), key=key)


def test_one_of_each(docs_of, prose):
    rows = near_copies(prose)
    df = docs_of(rows, extra=("row_name",))
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    want = collections.Counter()
    full = classes([(i if d is None else d, t) for i, (d, t) in enumerate(rows)])
    assert len({c for _, n, c in full if n}) <= kept.filter("text RLIKE '[^ \\t\\n]'").count() <= len(rows)
    got = kept.collect()
    for d, t in {(r["doc_id"], r["text"]) for r in got}:
        want[d, t] += 1
    assert sum(1 for r in got if not shingles(r["text"])) == sum(1 for _, t in rows if not shingles(t))
    texts = [r["text"] for r in got if shingles(r["text"])]
    assert len({frozenset(shingles(t)) for t in texts}) == len(texts)


def test_only_candidate_texts_are_shuffled(spark, docs_of, prose, monkeypatch):
    rows = [(i, prose(i, 200)) for i in range(60)] + [(100 + i, prose(7, 200) + f" w{i}") for i in range(3)] + [(None, prose(8, 200) + " x"), (None, prose(9, 200))]
    sent = []
    monkeypatch.setattr(ngram_join, "prefilter", lambda *a: sent.append(found := prefilter(*a)) or found)
    got = ngram_join.similar_documents(docs_of(rows)).collect()
    assert sorted(r["doc_id"] for r in sent[0].collect() if r["doc_id"] is not None) == [7, 8, 100, 101, 102] and sent[0].count() == 7
    assert {r["doc_id"] for r in got if r["component_id"] == 7} == {7, 100, 101, 102}
    assert len(got) == len(rows)


def test_hot_group_links_without_pairs():
    rng = np.random.RandomState(1)
    base = np.unique(rng.randint(1, 1 << 60, 400).astype(np.uint64))
    sets = []
    for i in range(600):
        s = set(base.tolist())
        for x in rng.choice(base, i % 30, replace=False).tolist():
            s.discard(x)
        s |= set(rng.randint(1, 1 << 60, i % 17).tolist())
        sets.append(np.array(sorted(s), np.uint64))
    got = ngram_join.linked(sets, 90, 100)
    pair = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(0, len(sets)):
        for j in range(i):
            if find(i) != find(j) and pair(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == [find(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 80), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 80, 90: 80, 80: 80}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w, hit, names = split(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((d, len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_contamination(spark, docs_of, prose, block_bytes):
    items = [(i, prose(1000 + i, 30)) for i in range(8)] + [(8, prose(1000, 30)), (20, "Only Four words-HERE"), (21, ""), (22, None), (None, prose(2000, 14)), (23, "éa ka")]
    docs = [(i, prose(i, 60)) for i in range(20)]
    docs += [(50 + i, f"{prose(70 + i, 20)} {items[i][1].upper()} {prose(90 + i, 1200)}") for i in range(8)]
    docs += [(80, None), (80, ""), (81, "x only, four\nwords here!"), (82, items[0][1].replace(" ", ", ")), (83, " ".join(items[1][1].split()[4:17])), (84, " ".join(items[1][1].split()[4:16])), (85, "ÉA ka"), (86, "éa KA"), (None, items[3][1]), (None, items[3][1]), (87, items[12][1] * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(docs, extra=("n_hit", "scan_text")), bench, ["doc_id"], block_bytes=block_bytes).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["hit_items"])) for r in got], key=key) == sorted(plain_contamination(docs, items), key=key)


def test_contamination_of_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs_of([(1, "a b")]), bench).collect()
    assert [(r["n_words"], r["n_hit"], r["hit_items"]) for r in got] == [(2, 0, [])]
    assert decontaminate.contamination(docs_of([]), bench).count() == 0


def without_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc, len(d), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_BUCKET, 2])
def test_repeated_text(spark, docs_of, prose, tables, monkeypatch, hot):
    monkeypatch.setitem(repeats.repeated_spans.__kwdefaults__, "hot_bucket", hot)
    passage, line = prose(7, 120, ("é", "ka", "ß")), prose(8, 60) + "\n"
    rows = [(i, prose(100 + i, 150)) for i in range(15)]
    rows += [(20 + i, f"{prose(200 + i, 50)} {passage[: 150 + 37 * i]} {prose(300 + i, 50)}") for i in range(10)]
    rows += [(40, line * 4), (41, "x" * 900), (42, "ab" * 400), (43, "ab" * 400), (44, None), (44, ""), (45, "y" * 199), (46, "y" * 199), (47, "z" * 200), (47, "z" * 200), (48, prose(1, 400)), (None, prose(1, 400)), (None, passage)]
    words = prose(500, 300).split()
    for i in range(12):
        words[i * 20] = f"edit{i}"
        rows.append((60 + i, " ".join(words)))
    folder = tables(documents=docs_of(rows, extra=("tag", "h")))
    key = lambda r: tuple(str(x) for x in r)
    got = [tuple(r) for r in QUERIES["op8_suffix_dedup"](spark, folder).collect()]
    assert sorted(got, key=key) == sorted(without_repeats(rows, 200), key=key)


def test_repeats_in_long_texts_and_empty_tables(spark, docs_of, prose, tables):
    long = prose(11, 300_000)
    assert len(long) > kernel.SLICE_BYTES
    at = kernel.SLICE_BYTES - 450
    rows = [(1, long), (2, "a" * 50 + long[at : at + 700]), (3, long[1000:1500] + "b" * 30)]
    got = {r["doc_id"]: r for r in QUERIES["op8_suffix_dedup"](spark, tables(documents=docs_of(rows))).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (1200, 2) and got[2]["n_removed"] == 700 and got[3]["n_removed"] == 500
    for name in ("op8_suffix_dedup", "op5_ngram_join"):
        assert QUERIES[name](spark, tables(documents=docs_of([]))).count() == 0
