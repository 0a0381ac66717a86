"""Ranked lexical search, reversed: items are the index, documents stream through it.

Two passes over the documents. The first counts documents, terms and, for the terms that items ask for, the documents
holding them. The second sends each document's term counts through a broadcast inverted index (term -> items and how
often each asks for it), adds up integer scores for a slice of documents at a time, and keeps a bounded heap per item and
task. The heaps meet in two steps, by item and group of tasks and then by item, so no task gets all of them.

Items are the stated query set. They are cut into blocks by hash until no block holds over twice `block_bytes` of text (or one
longer item); each block is one index and one pair of passes. Documents are never stored between passes.

Memory: a document is read in pieces, and scores are added up for as many documents as fit a bounded table of scores.
Sums stay exact: in doubles while every score is below 2**53, else in 64-bit integers.

Nulls: a null text has no term, a null doc_id comes last among equal scores, a null item_id is an item. Every row of either
table counts by itself, repeated ones too. Equal scores are ranked by doc_id; rows equal in both are interchangeable. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlake.llm.kernel import ALPHANUMERIC

TOP = 20
BLOCK_BYTES = 4 << 20
#: Tasks whose heaps meet first, by task number.
GROUPS = 64
#: Bytes of text that are split into words at once.
_PIECE = 1 << 20
#: Words of a slice of documents, cells of a table of scores, and additions made at once.
_WORDS, _CELLS, _ADDED = 1 << 18, 1 << 21, 1 << 21

#: ASCII capitals become small, bytes outside a term become a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if ALPHANUMERIC[c] else 32 for c in range(256))


def pieces(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; no piece ends within a term."""
    raw = ((text.encode() if isinstance(text, str) else text) or b"").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _PIECE else raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Index:
    """Inverted index over items: term -> (item number, times the item has it)."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.names = [name for name, _ in items]
        asked = [Counter(t for piece in pieces(text) for t in piece) for _, text in items]
        self.number = {t: k for k, t in enumerate(sorted({t for c in asked for t in c}))}
        rows = sorted((self.number[t], i, n) for i, c in enumerate(asked) for t, n in c.items())
        term, self.item, self.times = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.first = np.searchsorted(term, np.arange(len(self.number) + 1))

    def term_counts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of documents: first row, words of each row, then (row, term, count) of the terms asked for, by row."""
        width = len(self.number)
        keys, counts, words, pending, start = [], [], [], 0, 0

        def packed() -> None:
            """What was gathered becomes one run of distinct keys with counts."""
            key, into = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_inverse=True)
            n = np.bincount(into, np.concatenate(counts) if counts else None, len(key)).astype(np.int64)
            keys[:], counts[:] = [key], [n]

        for row, text in enumerate(texts):
            words.append(0)
            for terms in pieces(text.as_py()):
                words[-1] += len(terms)
                found = np.fromiter(map(self.number.get, terms, repeat(-1)), np.int64, len(terms))
                found = found[found >= 0]
                keys.append(found + (row - start) * width)
                counts.append(np.ones(len(found), np.int64))
                pending += len(terms)
                if pending > _WORDS:
                    packed()
                    pending = len(keys[0])
            if pending > _WORDS // 2 or row == len(texts) - 1:
                packed()
                yield start, np.array(words, np.int64), keys[0] // max(width, 1), keys[0] % max(width, 1), counts[0]
                keys, counts, words, pending, start = [], [], [], 0, row + 1


class Heaps:
    """The best TOP documents of each item, so far."""

    def __init__(self, index: Index, weights: np.ndarray, docs: int, terms: int, top: int) -> None:
        self.index, self.weights, self.docs, self.terms, self.top = index, weights, docs, terms, top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in index.names]
        self.floor = np.ones(len(index.names), np.int64)  # a lower score can't enter
        most = np.zeros(len(index.names))
        np.add.at(most, index.item, index.times * weights[np.repeat(np.arange(len(weights)), np.diff(index.first))] * 1e6)
        self.in_doubles = not len(most) or most.max() < 2**53

    def update(self, ids: list[int | None], words: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """Score a slice of documents, rows counted from 0."""
        index, items = self.index, len(self.index.names)
        long = np.array([75 + 25 * n * self.docs // self.terms for n in words.tolist()], np.int64)
        worth = self.weights[term] * (1_000_000_000 * count // (1000 * count + 12 * long[row]))
        asked = index.first[term + 1] - index.first[term]
        added = np.concatenate([[0], np.cumsum(np.bincount(row, asked, len(ids)).astype(np.int64))])
        bounds = np.searchsorted(row, np.arange(len(ids) + 1))
        a = 0
        while a < len(ids):
            b = int(np.searchsorted(added, added[a] + _ADDED, "right")) - 1
            b = max(a + 1, min(b, a + max(1, _CELLS // items), len(ids)))
            part = slice(bounds[a], bounds[b])
            n = asked[part]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first[term[part]], n)
            cell = np.repeat(row[part] - a, n) * items + index.item[at]
            value = np.repeat(worth[part], n) * index.times[at]
            if self.in_doubles:
                scores = np.bincount(cell, value, (b - a) * items).astype(np.int64)
            else:
                scores = np.zeros((b - a) * items, np.int64)
                np.add.at(scores, cell, value)
            scores = scores.reshape(b - a, items)
            for i, j in zip(*(x.tolist() for x in np.nonzero(scores >= self.floor)), strict=True):
                self._push(j, int(scores[i, j]), ids[a + i])
            a = b

    def _push(self, item: int, score: int, doc: int | None) -> None:
        heap, entry = self.heaps[item], (score, -(1 << 63) - 1 if doc is None else -doc)
        if len(heap) < self.top:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.top:
            self.floor[item] = max(1, heap[0][0])

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, doc in heap:
                yield item, None if doc < -(1 << 63) else -doc, score


def weight(docs: int, holding: int) -> int:
    """floor(1000 * ln((2N + 2) / (2df + 1)))"""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=list(names))


def _counted(docs: DataFrame, shared) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all, and the documents holding each term asked for; the driver gets a row per term of the index."""

    def count(batches):
        index = shared.value
        holding, some, terms = np.zeros(len(index.number), np.int64), 0, 0
        for batch in batches:
            for _, words, _, term, _ in index.term_counts(batch.column(0)):
                holding += np.bincount(term, minlength=len(holding)).astype(np.int64)
                some, terms = some + int((words > 0).sum()), terms + int(words.sum())
        rows = [(k, n, 0) for k, n in enumerate(holding.tolist()) if n] + [(-1, some, terms)]
        yield _batch(rows, ("term", "n", "terms"))

    found = docs.select("text").mapInArrow(count, "term long, n long, terms long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).collect()
    whole = next((r for r in found if r["term"] == -1), Row(term=-1, n=0, terms=0))
    return whole["n"], whole["terms"], {r["term"]: r["n"] for r in found if r["term"] >= 0}


def _blocks(items: DataFrame, block_bytes: int) -> int:
    """So many blocks that none is over twice block_bytes, but for a longer single item."""
    sized = items.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    blocks = max(1, -(-total["n"] // block_bytes))
    while blocks > 1 and sized.groupBy(F.pmod("key", F.lit(blocks))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > max(2 * block_bytes, total["most"]) and blocks < total["n"]:
        blocks *= 2
    return blocks


def ranked(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `top` documents of the highest scores above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = items.select("item_id", "text", F.xxhash64("item_id", "text").alias("key"))
    blocks = _blocks(asked, block_bytes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        block = asked.filter(F.pmod("key", F.lit(blocks)) == k).collect()
        index = Index([(r["item_id"], r["text"]) for r in block])
        shared = spark.sparkContext.broadcast(index)
        n, terms, holding = _counted(rows, shared)
        if not holding:
            continue
        weights = np.array([weight(n, holding.get(t, 0)) for t in range(len(index.number))], np.int64)

        def search(batches, shared=shared, weights=weights, n=n, terms=terms):
            heaps = Heaps(shared.value, weights, n, terms, top)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, words, row, term, count in shared.value.term_counts(batch.column(1)):
                    heaps.update(ids[first : first + len(words)], words, row, term, count)
            yield _batch(list(heaps.rows()), ("item", "doc_id", "score"))

        best = rows.mapInArrow(search, "item long, doc_id long, score long").withColumn("tasks", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item", "tasks").orderBy(*order))).filter(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, name) for i, name in enumerate(index.names)], "item long, item_id long")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names: of one block
    return out
