"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. Per pattern length, a shift table over hashed blocks of words says
how far a window's end may jump without passing an occurrence; where it says 0, the block's bucket lists the patterns
that end in it, and their words are compared with the text itself. Many documents are scanned at once, one cursor for
each stretch of words.

The benchmark is the stated query set: it is cut into blocks of at most `block_bytes` of text, each block is one
broadcast table and one pass over the documents; with one block nothing is written between passes.

Nulls: a null text has no words, a null item id is written as the empty text. Items of the same id are one item; windows
that several items share count for each. Empty tables give no hits or no rows. Columns of the output's names are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.llm import kernel as K
from claimlake.llm.common import fresh, quoted, stash

WINDOW = 13
BLOCK = 3
BLOCK_BYTES = 16 << 20
_TABLE_BITS = 17
#: Words that one cursor scans.
_STRETCH = 512


def item_words(text: str | None) -> list[bytes]:
    data = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALPHANUMERIC)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


class PatternSet:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]]) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.patterns = patterns
        texts = list(patterns)
        data = np.frombuffer(b" ".join(texts), np.uint8)
        starts, ends, _ = K.words(data, np.array([0, len(data)]), K.NOT_SPACE)
        hashes = K.span_hash(K.prefix_hash(data), starts, ends).reshape(len(texts), length)
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.int64)
        last = length - self.block
        for j in range(last + 1):
            at = K.window_hash_rows(hashes[:, j : j + self.block])
            np.minimum.at(self.shift, at >> np.uint64(64 - _TABLE_BITS), last - j)
        buckets = defaultdict(list)
        for h, t in zip(at.tolist(), texts, strict=True):
            buckets[h].append(t)
        self.buckets = dict(buckets)
        self.suffixes = np.array(sorted(buckets), np.uint64)

    def occurrences(self, hashes: np.ndarray, firsts: np.ndarray, lower: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(first word, pattern) of every occurrence."""
        blocks = K.window_hash(hashes, self.block)
        if not len(blocks):
            return
        begin, stop = firsts[:-1] + self.length - 1, firsts[1:]  # the last word of a window goes from begin to stop - 1
        n = np.maximum(0, -(-(stop - begin) // _STRETCH))
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin, n) + part * _STRETCH
        until = np.minimum(at + _STRETCH, np.repeat(stop, n))
        slots = (blocks >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        found = []
        while len(at):
            jump = self.shift[slots[at - self.block + 1]]
            stopped = jump == 0
            if stopped.any():
                found.append(at[stopped])
            at = at + np.maximum(jump, 1)
            going = at < until
            at, until = at[going], until[going]
        if not found:
            return
        at = np.concatenate(found)
        tail = blocks[at - self.block + 1]
        where = np.minimum(np.searchsorted(self.suffixes, tail), len(self.suffixes) - 1)
        known = self.suffixes[where] == tail
        for end, h in zip(at[known].tolist(), tail[known].tolist(), strict=True):
            first = end - self.length + 1
            said = b" ".join([lower[starts[i] : ends[i]] for i in range(first, end + 1)])
            for pattern in self.buckets[h]:
                if pattern == said:
                    yield first, pattern


def pattern_sets(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[list[PatternSet], list[str]]:
    """Searchers by pattern length, and the names that their item numbers stand for."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    by_length: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        said = item_words(text)
        k = min(window, len(said))
        for i in range(len(said) - k + 1 if k else 0):
            by_length[k][b" ".join(said[i : i + k])].add(number[name])
    return [PatternSet(k, {p: sorted(v) for p, v in found.items()}) for k, found in sorted(by_length.items())], names


def scan(texts: pa.Array, sets: list[PatternSet]) -> Iterator[tuple[int, int, list[int], set[int]]]:
    """(row, words, flat word spans hit, item numbers) of every text."""
    for first, last, data, offsets in K.slices(texts):
        lower = K.LOWER[data]
        starts, ends, firsts = K.words(lower, offsets, K.ALPHANUMERIC)
        hashes = K.span_hash(K.prefix_hash(lower), starts, ends)
        spans, items, raw = defaultdict(list), defaultdict(set), None
        for one in sets:
            if raw is None:
                raw = lower.tobytes()
            for at, pattern in one.occurrences(hashes, firsts, raw, starts, ends):
                row = int(np.searchsorted(firsts, at, "right")) - 1
                spans[row] += (at - int(firsts[row]), at - int(firsts[row]) + one.length)
                items[row].update(one.patterns[pattern])
        for row in range(last - first):
            yield first + row, int(firsts[row + 1] - firsts[row]), spans.get(row, []), items.get(row, set())


def merged(spans: list[int]) -> list[int]:
    """The union of flat (start, end) spans, in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns (all but clashing ones by default) with n_words, n_hit and hit_items (names, sorted)."""
    spark = docs.sparkSession
    outs = ("n_words", "n_hit", "hit_items")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outs]
    text, words_at, hit_at, spans_at, items_at = fresh(docs, "scan_text", "scan_words", "scan_hit", "scan_spans", "scan_items")
    rows = docs.select(*[quoted(c) for c in keep], F.col("text").alias(text), F.lit(0).cast("long").alias(words_at), F.lit(0).cast("long").alias(hit_at), F.array().cast("array<int>").alias(spans_at), F.array().cast("array<string>").alias(items_at))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    held = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-held // block_bytes))
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(pattern_sets([(r["item"], r["text"]) for r in block.collect()], window))

        def search(batches, shared=shared):
            sets, names = shared.value
            for batch in batches:
                table = pa.Table.from_batches([batch])
                n, spans, hit = [], table.column(spans_at).to_pylist(), table.column(items_at).to_pylist()
                for row, count, more, found in scan(batch.column(batch.schema.get_field_index(text)), sets):
                    n.append(count)
                    if more:
                        spans[row] = merged(spans[row] + more)
                        hit[row] = sorted({*hit[row], *(names[i] for i in found)})
                for name, values, kind in ((words_at, n, pa.int64()), (hit_at, [sum(x[1::2]) - sum(x[::2]) for x in spans], pa.int64()), (spans_at, spans, pa.list_(pa.int32())), (items_at, hit, pa.list_(pa.string()))):
                    table = table.set_column(table.column_names.index(name), name, pa.array(values, kind))
                yield from table.to_batches()

        rows = rows.mapInArrow(search, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]))
        if k < blocks - 1:
            rows = stash(rows)
    return rows.select(*[quoted(c) for c in keep], F.col(words_at).alias("n_words"), F.col(hit_at).alias("n_hit"), F.col(items_at).alias("hit_items"))
