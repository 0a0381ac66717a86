"""N-gram Jaccard join by a token-group matrix.

Documents that may be similar are put into groups, the union of each group's tokens is kept, a query group's overlap
with another group's union is bounded, and only qualifying groups are opened.

Steps. (1) Equal word sequences are one class. (2) A class's tokens are its shingles in one global order, frequent ones
last, and it shows the first p = |A| - ceil(t |A|) + l of them, l = 1 + |A| / SPARE. Two classes that reach the threshold t show at
least min(l, l') tokens in common. So a class that shows fewer tokens in common with all others together links with none; dropping
such classes, their tokens leave the count, and a few rounds of this leave little but real groups. Any number of rounds gives
the same links. (3) Classes that still share a token, directly or through others, form a candidate group. A group of more than
BLOCK_SHINGLES is cut into blocks by size band (partners' sizes differ by less than one band) and, in a band, by the first token in
the global order, which similar classes mostly share; the matrix of (token, block), tokens of the same blocks taken together,
bounds the overlap of any two members of two blocks, and only block pairs that can reach the least l are opened.
(4) Inside a block or a pair of blocks, sets are held as differences from the tokens that most members share. With slack =
(den - num) |A| - (den + num) |difference of A|, A and B are linked exactly if slack A + slack B + 2 (den + num) |common
differences| >= 0. So all members link to the one of most slack without looking at pairs, and only those that do not are
compared, over the differences they share. (5) Links give components.

The list of frequent shingles only orders tokens, so that common passages do not bring documents together; any order
gives the same links. It is cut at HOT_LIMIT entries, the bound of what is broadcast. Classes and shingles are named by
64-bit content hashes.

Nulls and empty texts have no shingles and are their own component. A null doc_id counts as no id: its component is
named by the other members. Repeated rows and equal texts share a component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.llm import kernel as K
from claimlake.llm.common import WORD, fresh, prefilter, quoted, stash
from claimlake.llm.graph import components
from claimlake.session import drop_stored

#: Shingles that one task holds at a time, at most twice as many.
BLOCK_SHINGLES = 1 << 21
HOT_LIMIT = 1 << 16
#: Places of first tokens in a band's order.
CELLS = 1 << 12
#: One more token is shown, and asked for in common, for so many shingles.
SPARE = 20
ROUNDS = 3
#: A shingle counts as frequent from so many documents of one task's run of shingles, and so many in all.
_HOT_LOCAL, _HOT_TOTAL, _HOT_RUN = 4, 64, 1 << 22
_TOP = np.uint64(1 << 63)


class Shingler:
    """Sorted shingle sets of whole texts as 64-bit keys; keys of frequent shingles sort last."""

    def __init__(self, k: int, hot: np.ndarray | None = None) -> None:
        self.k = k
        self.hot = hot if hot is not None else np.zeros(0, np.uint64)
        order = np.argsort(self.hot)
        self.sorted_hot, self.rank = self.hot[order], order.astype(np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def digests(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Digests alone."""
        for _, _, data, offsets in K.slices(texts):
            lower = K.LOWER[data]
            starts, ends, firsts = K.words(lower, offsets, K.NOT_SPACE)
            yield from K.sequence_digest(K.span_hash(K.prefix_hash(lower), starts, ends), firsts)

    def sets(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(two-part digest of the word sequence, keys) of every text."""
        for first, last, data, offsets in K.slices(texts):
            lower = K.LOWER[data]
            starts, ends, firsts = K.words(lower, offsets, K.NOT_SPACE)
            hashes = K.span_hash(K.prefix_hash(lower), starts, ends)
            digests = K.sequence_digest(hashes, firsts)
            keys = K.window_hash(hashes, self.k) >> np.uint64(1)
            if len(self.hot):
                at = np.flatnonzero(self.maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.sorted_hot, keys[at]), len(self.hot) - 1)
                known = self.sorted_hot[place] == keys[at]
                keys[at[known]] = _TOP | self.rank[place[known]]
            for row in range(last - first):
                a, b = int(firsts[row]), int(firsts[row + 1])
                if b - a >= self.k:
                    yield digests[row], np.unique(keys[a : b - self.k + 1])
                else:
                    yield digests[row], digests[row, :1] >> np.uint64(1) if b > a else keys[:0]


def scan(docs: DataFrame, k: int) -> DataFrame:
    """One pass: a row (doc_id, cls, n, key: the class as a number) for each document, and rows (key, often) of shingles that many of a task's documents have."""
    doc_kind = docs.schema["doc_id"].dataType

    def read(batches):
        shingler, run, held = Shingler(k), [], 0

        def rows(ids, cls, n, keys, often):
            return pa.RecordBatch.from_arrays([ids, pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(often, pa.int64())], ["doc_id", "cls", "n", "key", "often"])

        def frequent():
            keys, n = np.unique(np.concatenate(run), return_counts=True)
            some = n >= _HOT_LOCAL
            keys, none = keys[some].astype(np.int64), [None] * int(some.sum())
            return rows(pa.array(none, kind), none, none, keys, n[some])

        for batch in batches:
            kind, cls, cid, n = batch.column(0).type, [], [], []
            for digest, keys in shingler.sets(batch.column(1)):
                cls.append(digest.tobytes())
                cid.append(digest[0])
                n.append(len(keys))
                run.append(keys)
                held += len(keys)
                if held >= _HOT_RUN:
                    yield frequent()
                    run, held = [], 0
            yield rows(batch.column(0), cls, n, np.array(cid, np.uint64).view(np.int64), [None] * len(n))
        if run:
            yield frequent()

    return docs.mapInArrow(read, f"doc_id {doc_kind.simpleString()}, cls binary, n long, key long, often long")


def frequent_shingles(scanned: DataFrame) -> np.ndarray:
    """Keys of frequent shingles, rarest first."""
    counted = scanned.filter("cls IS NULL").groupBy("key").agg(F.sum("often").alias("n"))
    top = counted.filter(F.col("n") >= _HOT_TOTAL).orderBy(F.desc("n"), "key").limit(HOT_LIMIT).collect()
    return np.array([r["key"] for r in reversed(top)], np.int64).astype(np.uint64)


def shown_tokens(docs: DataFrame, shared: Broadcast, num: int, den: int) -> DataFrame:
    """token, cid, n: the tokens that a class shows."""
    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                cid, size, shown = [], [], []
                for digest, keys in shared.value.sets(batch.column(0).slice(at, 1024)):
                    if len(keys):
                        shown.append(keys[: len(keys) - -(-num * len(keys) // den) + 1 + len(keys) // SPARE])
                        cid.append(digest[0])
                        size.append(len(keys))
                if shown:
                    n = [len(x) for x in shown]
                    columns = (np.concatenate(shown), np.repeat(np.array(cid, np.uint64), n), np.repeat(np.array(size, np.uint64), n))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["token", "cid", "n"])

    return docs.select("text").mapInArrow(read, "token long, cid long, n long")


def asked(n: Column, num: int, den: int) -> Column:
    """Tokens that a class of n shingles must show in common with a partner, whose size is num / den of n at least."""
    least = F.ceil(n * num / den)
    return 1 + F.floor(least / SPARE)


def shared_tokens(tokens: DataFrame, num: int, den: int, rounds: int = ROUNDS) -> DataFrame:
    """token, cid, n, hub: tokens shown by two classes at least, of classes that show enough of them; hub is the token's least class."""
    by_token = W.partitionBy("token")

    def twice(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("hub", F.min("cid").over(by_token)).withColumn("top", F.max("cid").over(by_token))
            .filter(F.col("hub") != F.col("top")).select("token", "cid", "n", "hub").distinct()
        )

    left = stash(twice(tokens))
    for _ in range(rounds):
        enough = left.groupBy("cid", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= asked(F.col("n"), num, den)).select(F.col("cid").alias("e"))
        before = left
        left = stash(twice(before.join(enough, F.col("cid") == F.col("e"), "left_semi").select("token", "cid", "n")))
        drop_stored(before)
    return left


def linked(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the first set of its component under the exact threshold."""
    m = len(sets)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)

    if m > 1:
        less, more = den - num, den + num
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
        held = np.concatenate(sets)
        order = np.argsort(held, kind="stable")
        held = held[order]
        new = np.ones(len(held), bool)
        new[1:] = held[1:] != held[:-1]
        del held
        token = np.empty(len(order), np.int32)
        token[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        count = np.bincount(token)
        central = count * 2 > m
        apart = sizes + central.sum() - 2 * np.bincount(owner, central[token], m).astype(np.int64)
        slack = less * sizes - more * apart
        best = int(np.argmax(slack))
        near = slack + slack[best] >= 0
        near[best] = True
        for i in np.flatnonzero(near).tolist():
            join(i, best)
        rest = np.flatnonzero(~near)
        if len(rest):
            outside = ~central[token] & (count[token] > 1)
            present = np.zeros((int(central.sum()), m), bool)
            inside = central[token]
            present[(np.cumsum(central) - 1)[token[inside]], owner[inside]] = True
            lacking, lacker = np.nonzero(~present)
            t = np.concatenate([token[outside], (len(count) + lacking).astype(np.int32)])
            o = np.concatenate([owner[outside], lacker.astype(np.int32)])
            del outside, inside, present, lacking, lacker, owner, token
            by_token = np.argsort(t, kind="stable")
            posting = o[by_token]
            names, begin, length = np.unique(t[by_token], return_index=True, return_counts=True)
            slot = np.searchsorted(names, t).astype(np.int32)
            del t, by_token
            by_owner = np.argsort(o, kind="stable")
            bounds = np.searchsorted(o[by_owner], np.arange(m + 1))
            slot = slot[by_owner]
            del o, by_owner
            for i in rest.tolist():
                mine = slot[bounds[i] : bounds[i + 1]]
                n = length[mine]
                at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(posting[at], minlength=m)
                link = slack + slack[i] + 2 * more * common >= 0
                link[i] = False
                for j in np.flatnonzero(link).tolist():
                    join(i, j)
    return [find(i) for i in range(m)]


def similar_documents(docs: DataFrame, *, k: int = 3, num: int = 90, den: int = 100, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, cls, n, component_id, grp (the component as a number, null for empty sets): a row for each row of docs."""
    rows = docs.select("doc_id", "text")
    scanned = stash(scan(rows, k))
    info = scanned.filter("cls IS NOT NULL").select("doc_id", "cls", F.col("key").alias("cid"), "n")
    shared = docs.sparkSession.sparkContext.broadcast(Shingler(k, frequent_shingles(scanned)))
    shown = shared_tokens(shown_tokens(rows, shared, num, den), num, den)
    candidates = components(shown.filter(F.col("cid") != F.col("hub")).select(F.col("cid").alias("u"), F.col("hub").alias("v")).distinct())

    # groups: a whole candidate component, or its blocks where it is large. Members of a band are laid out by their first
    # token, which similar classes mostly share, and blocks are runs of this order; a run of one cell that is too large by itself is cut by class.
    first = F.min(F.col("token").bitwiseXOR(F.lit(-(1 << 63)))).alias("first")  # as the global order has it: frequent tokens last
    member = candidates.select(F.col("node").alias("cid"), "root").join(shown.groupBy("cid", "n").agg(first), "cid")
    held = member.groupBy("root").agg(F.sum("n").alias("held"))
    band = F.when(F.col("held") <= block_shingles, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9))
    banded = member.join(held, "root").withColumn("band", band.cast("int")).withColumn("cell", F.pmod(F.xxhash64("first"), F.lit(CELLS)))
    before = F.sum("in_cell").over(W.partitionBy("root", "band").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = banded.groupBy("root", "band", "cell").agg(F.sum("n").alias("in_cell"))
    cells = cells.select("root", "band", "cell", F.floor(F.coalesce(before, F.lit(0)) / block_shingles).alias("run"), F.ceil(F.col("in_cell") / block_shingles).alias("cuts"))
    cut = F.when(F.col("cuts") > 1, F.xxhash64("cell", F.pmod(F.xxhash64("cid"), F.col("cuts")))).otherwise(F.col("run"))
    grouped = stash(banded.join(cells, ["root", "band", "cell"]).withColumn("cut", cut).withColumn("grp", F.xxhash64("root", "band", "cut")).select("cid", "n", "root", "band", "grp", "held"))
    large = grouped.filter(F.col("held") > block_shingles)
    # blocks of one band, or of neighbouring bands, meet under the greater band
    matrix = shown.select("cid", "token").join(large.select("cid", "root", "band", "grp"), "cid").select("root", "token", "band", "grp").distinct()
    beside = matrix.withColumn("key", F.explode(F.array("band", F.col("band") + 1))).groupBy("root", "token", "key").agg(F.array_sort(F.collect_set(F.struct("band", "grp"))).alias("g"))
    # tokens that stand in the same blocks count once, with their number
    beside = beside.filter(F.size("g") > 1).groupBy("key", "g").agg(F.count("*").alias("tokens"))
    least = large.groupBy("grp").agg(F.min(asked(F.col("n"), num, den)).alias("l"))
    one_band = (F.col("a.band") == F.col("b.band")) & (F.col("a.band") == F.col("key"))
    opened = stash(
        beside.select("key", "tokens", F.explode("g").alias("a"), "g").select("key", "tokens", "a", F.explode("g").alias("b"))
        .filter((F.col("a.grp") < F.col("b.grp")) & (one_band | (F.col("a.band") != F.col("b.band"))))
        .groupBy(F.col("a.grp").alias("a"), F.col("b.grp").alias("b")).agg(F.sum("tokens").alias("overlap"))
        .join(least.select(F.col("grp").alias("a"), F.col("l").alias("la")), "a").join(least.select(F.col("grp").alias("b"), F.col("l").alias("lb")), "b")
        .filter(F.col("overlap") >= F.least("la", "lb")).select("a", "b")
    )
    pair = F.xxhash64("a", "b").alias("task")
    in_pairs = opened.select(F.col("a").alias("grp"), pair).unionByName(opened.select(F.col("b").alias("grp"), pair))
    alone = grouped.select("grp").distinct().join(in_pairs, "grp", "left_anti").select("grp", F.col("grp").alias("task"))
    work = stash(grouped.join(in_pairs.unionByName(alone), "grp").select("task", "cid", "n"))
    total = work.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-2 * total // block_shingles))

    # the texts of the candidates, one of each class, once for each task that opens it
    classes = stash(info.filter("n > 0").groupBy("cls", "cid").agg(F.min("doc_id").alias("first_doc")))
    wanted = stash(work.join(classes.select("cid", "cls", "first_doc"), "cid").select(F.col("first_doc").alias("d"), "cid", "cls", "task"))
    # most texts are of no candidate and stay where they are
    texts = prefilter(rows, F.col("doc_id"), wanted, F.col("d")).join(wanted, F.col("doc_id").eqNullSafe(F.col("d"))).select(F.pmod(F.xxhash64("task"), F.lit(buckets)).alias("bucket"), "task", "cid", "cls", "text")

    def link(table: pa.Table) -> pa.Table:
        groups: dict[int, dict[int, np.ndarray]] = {}
        ids = zip(table.column("task").to_pylist(), table.column("cid").to_pylist(), table.column("cls").to_pylist(), strict=True)
        found = (x for chunk in table.column("text").chunks for x in shared.value.sets(chunk))
        for (name, cid, cls), (digest, keys) in zip(ids, found, strict=True):
            if digest.tobytes() == cls:  # rows that share an id with a class's first row are not its text
                groups.setdefault(name, {})[cid] = keys
        u, v = [], []
        for group in groups.values():
            order = sorted(group)
            for cid, first in zip(order, linked([group[c] for c in order], num, den), strict=True):
                if order[first] != cid:
                    u.append(cid)
                    v.append(order[first])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    labels = components(texts.groupBy("bucket").applyInArrow(link, "u long, v long"))
    named = classes.select("cid", "cls", "first_doc").join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_class = named.join(smallest, "root").select(F.col("cls").alias("c"), "component_id", F.col("root").alias("grp"))
    return info.join(by_class, F.col("cls") == F.col("c"), "left").select("doc_id", "cls", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "grp")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one row of each component: that of the least id, a null id last. Texts without words all stay."""
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    found = similar_documents(docs, **options).filter("n > 0")
    first = found.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("one"))
    name, cls = fresh(docs, "row_name", "row_class")
    named = lambda i, c: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("none")), F.hex(c))
    kept = first.select(named(F.col("one.doc_id"), F.col("one.cls")).alias("kept_name"))
    shingler = Shingler(options.get("k", 3))

    def classify(batches):
        for batch in batches:
            digests = [d.tobytes() for d in shingler.digests(batch.column(batch.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, cls])

    columns = [quoted(c) for c in docs.columns]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(cls, T.BinaryType())])
    rows = docs.filter(has_word).mapInArrow(classify, schema).withColumn(name, named(F.col("doc_id"), F.col(cls)))
    return rows.join(kept, F.col(name) == F.col("kept_name"), "left_semi").dropDuplicates([name]).select(*columns).unionByName(docs.filter(~has_word))
