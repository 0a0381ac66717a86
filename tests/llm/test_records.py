"""Prefix trie, ranked search and archives against brute force and exact round trips."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from claimlake.llm import ranking, trie, warc


# ---- prefix trie ----


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        paths[c] = tuple(own.get(base, [])[:h] + said[h:])
    members = defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    out = []
    for node, who in members.items():
        below = [v for v in members if v[: len(node)] == node]
        children = lambda v: [u for u in members if len(u) == len(v) + 1 and u[:-1] == v]
        ends = ",".join(str(c) for c in sorted(who) if paths[c] == node)
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children(node)), sum(not children(v) for v in below),
            sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_rows(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in extra:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)


def some_conversations(seed, convs, longest, said=("a", "b", "é", "")):
    rng = random.Random(seed)
    return [(c, t, ("user", "assistant")[t % 2], rng.choice(said)) for c in convs for t in range(rng.randint(1, longest))]


def test_trie_of_short_conversations(spark):
    rows = some_conversations(1, range(-7, 40), 7)
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_long_conversations_over_many_blocks_and_pieces(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("PIECE", 2), ("ID_PIECE", 4)):
        monkeypatch.setattr(trie, name, value)
    rows = some_conversations(2, range(12), 40, ("a", "a", "a", "b"))
    rows += [(c, t, "user", f"same {t}") for c in range(20, 60) for t in range(25)]  # a third and more are copies
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (5, None, None, None), (5, 0, "user", None), (5, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "w"), (6, 0, "user", "x" * 50_000), (6, 1, None, ""),
        (None, 0, "user", "nobody's"), (8, 3, "user", "one turn"), (9, 0, "a:", "b"), (9, 1, "a", ":b"),
    ]
    assert trie_rows(spark, rows, ["id", "p", "block", "t0", "depth", "range", "N"]) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "a")]) == []


# ---- ranked search ----


def brute_ranking(docs, items, top=20):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    said = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in said)
    total = sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in said:
            score = 0
            for t, k in Counter(terms(text)).items():
                if c[t]:
                    m = 75 + 25 * sum(c.values()) * n // total
                    score += k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ranking_rows(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS score", "2 AS item_id", "3 AS rank", "4 AS tasks")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS key")
    return sorted((tuple(r) for r in ranking.ranked(d, i, **options).collect()), key=str)


def test_ranking_against_all_pairs(spark, prose):
    docs = [(k, prose(k, 5 + 7 * k % 90, ("ka", "Lo", "mí", "9"))) for k in range(120)] + [(200 + k, prose(3, 40)) for k in range(60)]
    items = [(k, prose(500 + k, 30, ("ka", "lo", "mí", "9", "-"))) for k in range(9)] + [(9, prose(3, 40))]
    assert ranking_rows(spark, docs, items) == brute_ranking(docs, items)


def test_ranking_in_small_pieces_slices_and_blocks(spark, prose, monkeypatch):
    for name, value in (("_PIECE", 16), ("_WORDS", 20), ("_CELLS", 30), ("_ADDED", 50), ("BLOCK_BYTES", 100)):
        monkeypatch.setattr(ranking, name, value)
    docs = [(k, prose(k % 30, 40)) for k in range(60)]
    items = [(k, prose(900 + k, 12)) for k in range(12)]
    index = ranking.Index(items)
    import pyarrow as pa

    slices = list(index.term_counts(pa.array([t.encode() for _, t in docs], pa.binary())))
    assert len(slices) > 5 and sum(len(w) for _, w, *_ in slices) == 60
    heaps = ranking.Heaps(index, __import__("numpy").ones(len(index.number), "int64"), 60, 2400, 5)
    for first, words, row, term, count in slices:
        heaps.update([d for d, _ in docs][first : first + len(words)], words, row, term, count)
    assert all(len(h) == 5 for h in heaps.heaps)
    assert ranking_rows(spark, docs, items, block_bytes=100) == brute_ranking(docs, items)


def test_ranking_exact_beyond_doubles(spark):
    docs = [(k, "rare " * (k + 1)) for k in range(30)] + [(100 + k, "other") for k in range(100)]
    items = [(1, "rare " * 30_000_000 + "other")]
    found = ranking_rows(spark, docs, items, top=7)
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == [29, 28, 27, 26, 25, 24, 23]
    n, total = 130, sum(range(1, 31)) + 100
    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * 30 + 1)))
    expected = 30_000_000 * weight * (1_000_000_000 * 30 // (1000 * 30 + 12 * (75 + 25 * 30 * n // total)))
    assert max(r[3] for r in found) == expected > 2**53


def test_ranking_of_nulls_ties_repeats_and_nothing(spark):
    docs = [(None, "cat dog"), (3, "cat dog"), (3, "cat dog"), (1, "cat dog"), (4, None), (5, ""), (6, "!!!"), (7, "zebra " * 5), (8, "zebra")]
    items = [(None, "cat"), (2, "cat"), (2, "cat"), (3, None), (4, "absent"), (5, "Zebra zebra")]
    assert ranking_rows(spark, docs, items) == brute_ranking(docs, items)
    assert ranking_rows(spark, [], items) == [] == ranking_rows(spark, docs, [])


# ---- archives ----

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_pages(rows):
    top = {}
    for page, _, html in rows:
        top[html or ""] = max(top.get(html or "", -(2**63)), -(2**63) if page is None else page)
    out = []
    for page, _, html in rows:
        t = top[html or ""]
        t = None if t == -(2**63) else t
        out.append((page, len((html or "").encode()), digest(html), "response" if page == t else "revisit", None if page == t else t))
    return sorted(out, key=str)


def test_pages_round_trip(spark, tmp_path):
    rows = [(k, f"http://x/{k}", "hot copy") for k in range(40)] + [
        (50, None, None), (51, "http://é/ ü\r\nEvil: 1", ""), (52, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (53, "u", "é" * 300_000), (54, "u", "\r\n\r\n"), (None, "u", "lone"), (None, "u", "hot copy"),
        (60, "u", "twice"), (60, "u", "twice"), (59, "u", "twice"),
    ]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "'y' AS payload", "1 AS n", "2 AS first").repartition(4)
    for level in (4, 0):
        path = str(tmp_path / f"a{level}")
        warc.archived(pages, path, level=level, fileBytes=20_000)
        found = sorted((tuple(r) for r in warc.page_records(spark, path).collect()), key=str)
        assert found == expected_pages(rows)
        back = {(r["record_id"], r["payload"].decode()) for r in warc.read_warc(spark, path).filter("record_type = 'response'").collect()}
        said = {page: html or "" for page, _, html in rows if page is not None} | {None: "lone"}
        assert back == {(f"<urn:page:{'' if p is None else p}>", said[p]) for p, _, _, kind, _ in expected_pages(rows) if kind == "response"}
    assert all("Evil" not in (r["headers"].get("evil") or "") and "evil" not in r["headers"] for r in warc.read_warc(spark, path).collect())


def test_short_payloads_are_all_responses(spark, tmp_path):
    warc.archived(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES), str(tmp_path / "a"), min_bytes=4)
    assert {(r["page_id"], r["record_type"]) for r in warc.page_records(spark, str(tmp_path / "a")).collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_empty_tables_and_folders(spark, tmp_path):
    warc.archived(spark.createDataFrame([], PAGES), str(tmp_path / "a"))
    assert warc.page_records(spark, str(tmp_path / "a")).collect() == []


def test_filters_reach_the_scan_and_unwanted_payloads_are_not_decoded(spark, tmp_path):
    rows = [{"record_type": "metadata" if k % 3 else "response", "record_id": f"<r:{k}>", "target_uri": f"http://h{k % 2}/{k}", "payload": bytes([k]) * 400_000} for k in range(30)]
    plain = b"".join(warc.encoded(r) for r in rows)
    members = [bytearray(warc.member(warc.encoded(r), 1)) for r in rows]
    for k, m in enumerate(members):
        if k % 3:  # broken behind the header's bytes: inflating it would raise
            m[-400:-8] = b"\xff" * 392 if len(m) > 800 else m[-400:-8]
            m[-8:-4] = b"\0\0\0\0"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    found = warc.read_warc(spark, str(tmp_path / "a.warc.gz")).filter("record_type = 'response' AND target_uri LIKE 'http://h0/%'")
    assert {r["record_id"] for r in found.collect()} == {f"<r:{k}>" for k in range(0, 30, 6)}
    with pytest.raises(Exception, match="gzip|incorrect|inflat|decompress"):
        warc.read_warc(spark, str(tmp_path / "a.warc.gz")).filter("record_type = 'metadata'").collect()

    class Counting:
        def __init__(self, data):
            import io

            self.file, self.bytes = io.BytesIO(data), 0

        def read(self, n):
            got = self.file.read(n)
            self.bytes += len(got)
            return got

        def seek(self, *a):
            return self.file.seek(*a)

        def tell(self):
            return self.file.tell()

    file = Counting(plain)
    assert [r["record_id"] for r in warc.records(file, lambda r: r["record_id"] == "<r:29>", False)] == ["<r:29>"]
    assert file.bytes < len(plain) * 0.8


@pytest.mark.parametrize("test", ["record_id IN ('<r:1>', '<r:2>', null)", "content_length > 3", "NOT record_type = 'a'", "refers_to IS NULL", "refers_to <=> null AND record_id >= '<r:3>'", "record_id LIKE '%:4>' OR record_type = 'b'", "headers['warc-type'] = 'b'", "date <> 'x'"])
def test_pushed_filters_agree_with_spark(spark, tmp_path, test):
    rows = [{"record_type": "ab"[k % 2], "record_id": f"<r:{k}>", "refers_to": None if k % 3 else "<q>", "date": None if k % 4 else str(k), "payload": b"x" * k} for k in range(8)]
    (tmp_path / "a.warc").write_bytes(b"".join(warc.encoded(r) for r in rows))
    whole = warc.read_warc(spark, str(tmp_path))
    memory = spark.createDataFrame(whole.collect(), whole.schema)
    assert sorted(r["record_id"] for r in whole.filter(test).collect()) == sorted(r["record_id"] for r in memory.filter(test).collect())


def test_archives_of_other_writers(spark, tmp_path):
    one = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <a>\r\nX-Long: first\r\n second\r\nWARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = one.replace(b"<a>", b"<d>").replace(b"hello", b"world")
    (tmp_path / "each.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(one + two))
    (tmp_path / "plain.warc").write_bytes(one + b"\r\n\r\n" + two)
    (tmp_path / "_hidden.warc").write_bytes(b"not read")
    (tmp_path / "other.txt").write_bytes(b"not read")
    for name in ("each.warc.gz", "whole.warc.gz", "plain.warc"):
        rows = warc.read_warc(spark, str(tmp_path / name)).collect()
        assert [(r["record_id"], bytes(r["payload"]), r["headers"]["x-long"], r["headers"]["warc-concurrent-to"]) for r in rows] == [("<a>", b"hello", "first second", "<b>, <c>"), ("<d>", b"world", "first second", "<b>, <c>")]
        assert [r["record_id"] for r in warc.read_warc(spark, str(tmp_path / name)).filter("record_id = '<d>'").collect()] == ["<d>"]
    assert warc.read_warc(spark, str(tmp_path)).count() == 6
    (tmp_path / "torn.warc").write_bytes(one[:-20])
    with pytest.raises(Exception, match="torn.warc"):
        warc.read_warc(spark, str(tmp_path / "torn.warc")).collect()


def test_files_are_rolled_planned_and_committed_once(spark, tmp_path):
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 2000) AS html").repartition(3)
    path = tmp_path / "a"
    warc.archived(pages, str(path), fileBytes=4000)
    names = [f.name for f in path.iterdir()]
    assert len(names) > 3 and not [n for n in names if n.startswith("_")]
    reader = warc.WarcReader(None, {"path": str(path), "partitionBytes": "9000"})
    plans = reader.partitions()
    assert len(plans) > 2 and sorted(p.rpartition("/")[2] for f in plans for p in f.paths) == sorted(names)
    warc.archived(pages.limit(5), str(path), mode="overwrite")
    assert warc.read_warc(spark, str(path), ["record_id"]).count() == 5
    failing = pages.selectExpr("page_id", "url", "if(page_id = 150, raise_error('stop'), html) AS html")
    with pytest.raises(Exception, match="stop"):
        warc.archived(failing, str(path))
    assert warc.read_warc(spark, str(path), ["record_id"]).count() == 5
