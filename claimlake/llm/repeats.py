"""Suffix dedup by bucket-pointer refinement: removes bytes under any `length`-byte string that starts twice.

Suffixes are sampled: in every window of `length` bytes the q-gram of least hash is an anchor, so two equal windows have
equal anchors at equal offsets, and only suffixes at anchors need buckets.

(1) Initial buckets: anchors by q-gram; a bucket of one is done. (2) An anchor's hull, all bytes of windows that can hold
it, names its refined bucket. Where a hull occurs twice, all its windows are repeated; one member stands for the bucket from
then on, so a large group of copies goes on as one. Equal whole texts are one from the start. (3) For the rest, windows
are refined by the bucket identifiers at later offsets: b(s), b(s+q) give id2(s); id2(s), id2(s+2q) give id4(s), and so on up to
`length`. Windows of equal identifier and offset to their anchor are equal. Buckets of more than `hot_bucket` members are
refined the same way, but their identifiers are counted by Spark over all tasks instead of inside one.

Identifiers are 64-bit content hashes, compared only inside a q-gram's bucket. Nulls: a null text is empty; a null doc_id is an
id. Texts under `length` bytes keep all. Repeated rows are copies of each other. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlake.llm import kernel as K
from claimlake.llm.common import stash

LENGTH, Q = 200, 40
#: Members of a bucket from which its windows are counted over all tasks.
HOT_BUCKET = 20_000
#: Buckets, at most, that are split over tasks, of those with so many anchors in one run of documents.
SPLIT_BUCKETS, _OFTEN = 1024, 32
_CHUNK_ROWS = 4096
_FILTER_BITS = 1 << 23
_PLACE_BITS = 20
_U = np.uint64


def tags(texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """(content digest, bytes) of every text."""
    for first, last, data, offsets in K.slices(texts):
        raw = data.tobytes()
        for row in range(last - first):
            text = raw[offsets[row] : offsets[row + 1]]
            yield hashlib.blake2b(text, digest_size=16).digest(), text


def tag_of(digest: bytes) -> int:
    """A short part of the digest that, with the id, names a text."""
    return int.from_bytes(digest[:4], "little", signed=True)


def anchor_starts(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of the anchors of all windows; a window's anchor is its leftmost q-gram of least hash."""
    w, step = length - q + 1, (1 << _PLACE_BITS) - 2 * length
    at, rows = [], []
    for begin in range(0, max(0, len(data) - length + 1), step):
        n = min(step, len(data) - length + 1 - begin)  # windows that start here
        pos = np.arange(begin, begin + n + w - 1)
        key = (K.span_hash(prefix, pos, pos + q) >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(pos), dtype=_U)
        padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, _U)
        padded[: len(key)] = key
        grid = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        found = (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64) + begin
        starts = np.arange(begin, begin + n)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, begin, begin + n)))
        inside = starts + length <= offsets[row + 1]
        found, row = found[inside], row[inside]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        at.append(found[new])
        rows.append(row[new])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, rows = np.concatenate(at), np.concatenate(rows)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]  # an anchor met again at the next chunk
    return at[new], rows[new]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tag, digest, n_bytes, sha: one row for each row of docs."""
    def read(batches):
        for batch in batches:
            digest, tag, size, sha = [], [], [], []
            for d, text in tags(batch.column(1)):
                digest.append(d)
                tag.append(tag_of(d))
                size.append(len(text))
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tag, pa.int32()), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "tag", "digest", "n_bytes", "sha"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {_kind(docs)}, tag int, digest binary, n_bytes long, sha string")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def anchors(docs: DataFrame, length: int, q: int) -> DataFrame:
    """doc_id, tag, p, h (q-gram bucket), g (hull bucket; null where the hull leaves the text), often (h is frequent nearby)."""
    def read(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in K.slices(batch.column(1)):
                raw = data.tobytes()
                tag = np.array([tag_of(hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=16).digest()) for i in range(last - first)], np.int32)
                prefix = K.prefix_hash(data)
                at, row = anchor_starts(data, offsets, prefix, length, q)
                low, high = at - (length - q), at + length
                whole = (low >= offsets[row]) & (high <= offsets[row + 1])
                hull = K.span_hash(prefix, np.where(whole, low, 0), np.where(whole, high, 0))
                h = K.span_hash(prefix, at, at + q).view(np.int64)
                _, which, count = np.unique(h, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row + first)), pa.array(tag[row], pa.int32()), pa.array((at - offsets[row]).astype(np.int64)),
                    pa.array(h), pa.array(hull.view(np.int64), mask=~whole), pa.array(count[which] >= _OFTEN),
                ], ["doc_id", "tag", "p", "h", "g", "often"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {_kind(docs)}, tag int, p long, h long, g long, often boolean")


def bucket_members(placed: DataFrame) -> DataFrame:
    """Anchors of buckets of two or more: doc_id, tag, p, open (no hull like it), member (goes on to refinement).

    The most frequent buckets pre-aggregate their hulls and meet them again in a join whose large partitions Spark
    splits; the others, one shuffle and no more, are looked at where they stand together. Both say the same of any bucket,
    so the list of frequent ones, at most SPLIT_BUCKETS long, need not be exact.
    """
    often = stash(placed.filter("often").groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(SPLIT_BUCKETS).select(F.col("h").alias("o")))
    few = placed.join(F.broadcast(often), F.col("h") == F.col("o"), "left_anti")
    by_bucket, by_hull = W.partitionBy("h"), W.partitionBy("h", "g")
    looked = (
        few.repartition("h").withColumn("nth", F.row_number().over(by_hull.orderBy("doc_id", "tag", "p")))
        .withColumn("open", F.col("g").isNull() | (F.count("*").over(by_hull) == 1))
        .withColumn("size", F.count("*").over(by_bucket)).withColumn("any_open", F.max("open").over(by_bucket)).filter(F.col("size") > 1)
        .select("doc_id", "tag", "p", "open", ((F.col("open") | (F.col("nth") == 1)) & F.col("any_open")).alias("member"))
    )
    many = placed.join(F.broadcast(often), F.col("h") == F.col("o"), "left_semi")
    hulls = many.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "p")).alias("one"))
    buckets = hulls.groupBy("h").agg(F.sum("n").alias("size"), F.max(F.col("g").isNull() | (F.col("n") == 1)).alias("any_open")).filter(F.col("size") > 1)
    said = hulls.join(buckets, "h").select(F.col("h").alias("bh"), F.col("g").alias("bg"), (F.col("g").isNull() | (F.col("n") == 1)).alias("open"), "any_open", "one")
    joined = many.join(said, (F.col("h") == F.col("bh")) & F.col("g").eqNullSafe(F.col("bg"))).select(
        "doc_id", "tag", "p", "open", ((F.col("open") | F.struct("doc_id", "tag", "p").eqNullSafe(F.col("one"))) & F.col("any_open")).alias("member"),
    )
    return looked.unionByName(joined)


def with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, tag, ...) with text. A filter of fixed size keeps most other texts out of the shuffle."""
    bit = F.pmod(F.col("tag"), F.lit(_FILTER_BITS))
    found = wanted.select((bit.cast("long") + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    bits = np.zeros(_FILTER_BITS, bool)
    for r in found:  # at most _FILTER_BITS / 32768 rows of 4 KB
        begin = (r["k"] - 1) * 32768
        bits[begin : begin + 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def read(batches):
        held = np.unpackbits(shared.value)
        for batch in batches:
            tag = np.array([tag_of(d) for d, _ in tags(batch.column(1))], np.int32)
            keep = held[tag.astype(np.int64) % _FILTER_BITS].astype(bool)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(tag), batch.column(1).cast(pa.string())], ["d", "t", "text"])
            yield out.filter(pa.array(keep))

    texts = docs.select("doc_id", "text").mapInArrow(read, f"d {_kind(docs)}, t int, text string")
    return wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))).drop("d", "t")


def window_ids(data: np.ndarray, length: int, q: int) -> np.ndarray:
    """Identifier of the window at every position, refined from q-gram buckets by pointers to later ones."""
    prefix = K.prefix_hash(data)
    at = np.arange(len(data) - q + 1)
    ids, reach = K.span_hash(prefix, at, at + q), q
    while reach < length:
        more = min(reach, length - reach)  # a pointer less than `reach` ahead overlaps; equal overlaps are equal texts
        n = len(ids) - more
        ids, reach = K.mixed(ids[:n] * _U(0x9E3779B97F4A7C15) + ids[more:]), reach + more
    return ids


def cut_contexts(rows: DataFrame, length: int, q: int) -> DataFrame:
    """(doc_id, tag, text, resolved, members) -> a row for each member anchor: h, p, open, left, ctx."""
    lead = length - q

    def read(batches):
        for batch in batches:
            table = batch.to_pydict()
            doc, tag, h, p, is_open, left, ctx = [], [], [], [], [], [], []
            for d, t, text, resolved, members in zip(table["doc_id"], table["tag"], table["text"], table["resolved"], table["members"], strict=True):
                raw = (text or "").encode()
                data = np.frombuffer(raw, np.uint8)
                at = np.array(sorted(members), np.int64)
                prefix = K.prefix_hash(data)
                h.append(K.span_hash(prefix, at, at + q).view(np.int64))
                done = set(resolved)
                for x in at.tolist():
                    a = max(0, x - lead)
                    doc.append(d)
                    tag.append(t)
                    p.append(x)
                    is_open.append(x not in done)
                    left.append(x - a)
                    ctx.append(raw[a : x + length])
            ids = np.concatenate(h) if h else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(doc, batch.schema.field("doc_id").type), pa.array(tag, pa.int32()), pa.array(p, pa.int64()), pa.array(is_open, pa.bool_()), pa.array(left, pa.int32()), pa.array(ctx, pa.binary())], ["h", "doc_id", "tag", "p", "open", "left", "ctx"])

    kind = _kind(rows)
    return rows.select("doc_id", "tag", "text", "resolved", "members").mapInArrow(read, f"h long, doc_id {kind}, tag int, p long, open boolean, left int, ctx binary")


def windows_of(left: np.ndarray, ctx: pa.Array, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x offsets to the anchor) window identifiers and which of them lie in the text."""
    _, offs, buf = ctx.buffers()
    offsets = np.frombuffer(offs, np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    back = np.arange(length - q + 1)
    start = (offsets[:-1] + left)[:, None] - back[None, :]
    valid = (back[None, :] <= left[:, None]) & (start + length <= offsets[1:, None])
    if len(data) < length:
        return np.zeros(start.shape, _U), np.zeros(start.shape, bool)
    ids = window_ids(data, length, q)
    out = ids[np.clip(start, 0, len(ids) - 1)]
    return K.mixed(out + back.astype(_U)[None, :] * _U(0xD6E8FEB86659FD93)), valid


def spans_of(twice: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under runs of repeated windows."""
    edge = np.zeros((twice.shape[0], twice.shape[1] + 2), np.int8)
    edge[:, 1:-1] = twice
    turn = np.diff(edge, axis=1)
    row, first = np.nonzero(turn == 1)
    _, after = np.nonzero(turn == -1)
    return row, p[row] - (after - 1), p[row] - first + length


def _span_batch(batch_ids: pa.Array, tag: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch_ids.take(pa.array(row)), pa.array(tag[row], pa.int32()), pa.array(a), pa.array(b)], ["doc_id", "tag", "a", "b"])


def refine_in_tasks(contexts: DataFrame, length: int, q: int) -> DataFrame:
    """Repeated spans of buckets that stand together: doc_id, tag, a, b."""
    def solve(table: pa.Table):
        table = table.combine_chunks()
        h = table.column("h").to_numpy()
        left, p, is_open = table.column("left").to_numpy(), table.column("p").to_numpy(), table.column("open").to_numpy()
        column = lambda name: table.column(name).chunk(0)
        ids, valid = windows_of(left.astype(np.int64), column("ctx"), length, q)
        flat = ids[valid]
        order = np.argsort(flat)
        same = flat[order][1:] == flat[order][:-1]
        again = np.zeros(len(flat), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        twice = np.zeros(ids.shape, bool)
        twice[valid] = again
        twice &= is_open[:, None]
        del h
        return _span_batch(column("doc_id"), table.column("tag").to_numpy(), *spans_of(twice, p, length))

    def read(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < _CHUNK_ROWS:
                continue
            table = pa.concat_tables(held)
            h = table.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # the last bucket may go on in the next batch
            done = 0
            while last - done > 0:
                end = min(done + _CHUNK_ROWS, last)
                if end < last:
                    end = int(np.searchsorted(h, h[end], "right"))
                end = min(end, last)
                yield solve(table.slice(done, end - done))
                done = end
            held = [table.slice(last)]
        table = pa.concat_tables(held) if held else None
        if table is not None and table.num_rows:
            yield solve(table)

    kind = _kind(contexts)
    rows = contexts.repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(read, f"doc_id {kind}, tag int, a long, b long")


def refine_over_tasks(contexts: DataFrame, length: int, q: int) -> DataFrame:
    """The same for hot buckets: window identifiers are counted by a grouped aggregate and joined back."""
    def read(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for start in range(0, table.num_rows, _CHUNK_ROWS):
                part = table.slice(start, _CHUNK_ROWS).combine_chunks()
                left, p = part.column("left").to_numpy().astype(np.int64), part.column("p").to_numpy()
                ids, valid = windows_of(left, part.column("ctx").chunk(0), length, q)
                row, back = np.nonzero(valid)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").chunk(0).take(at), part.column("tag").chunk(0).take(at), part.column("open").chunk(0).take(at), pa.array(p[row] - back), pa.array(ids[valid].view(np.int64))], ["doc_id", "tag", "open", "a", "w"])

    windows = contexts.mapInArrow(read, f"doc_id {_kind(contexts)}, tag int, open boolean, a long, w long")
    often = windows.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("w")
    return windows.filter("open").join(often, "w").select("doc_id", "tag", "a", (F.col("a") + length).alias("b"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, q: int = Q, hot_bucket: int = HOT_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(info, cuts). info: doc_id, tag, n_bytes, sha, copied (another row has the same text, of `length` bytes at least), one row
    for each row of docs. cuts: doc_id, tag, spans (flat start, end), for texts that lose a part and have no copy."""
    info = stash(fingerprints(docs))
    whole = info.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag")).alias("one")).filter((F.col("n") > 1)).select(F.col("digest").alias("e"), "one")
    info = stash(info.join(whole, F.col("digest") == F.col("e"), "left").select("doc_id", "tag", "n_bytes", "sha", (F.col("e").isNotNull() & (F.col("n_bytes") >= length)).alias("copied"), (F.col("e").isNotNull() & (F.struct("doc_id", "tag") == F.col("one"))).alias("stands")))

    ranked = bucket_members(stash(anchors(docs, length, q)))
    marks = ranked.groupBy("doc_id", "tag").agg(F.collect_list(F.when(~F.col("open"), F.col("p"))).alias("resolved"), F.collect_list(F.when(F.col("member"), F.col("p"))).alias("members"))
    known = info.filter("copied").select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "stands").distinct()
    marks = stash(
        marks.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
        .filter(F.col("stands").isNull() | F.col("stands")).select("doc_id", "tag", "resolved", "members", F.col("stands").isNotNull().alias("copied"))
    )
    contexts = stash(cut_contexts(with_text(docs, marks.filter(F.size("members") > 0).select("doc_id", "tag", "resolved", "members")), length, q))
    hot = stash(contexts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot_bucket).select("h"))
    found = refine_in_tasks(contexts.join(hot, "h", "left_anti"), length, q).unionByName(refine_over_tasks(contexts.join(hot, "h", "left_semi"), length, q))
    spans = found.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("spans")).select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "spans")
    hull = F.flatten(F.transform("resolved", lambda p: F.array(p - (length - q), p + length)))
    cuts = (
        marks.filter(~F.col("copied")).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
        .select("doc_id", "tag", F.concat(hull, F.coalesce("spans", F.array().cast("array<long>"))).alias("spans")).filter(F.size("spans") > 0)
    )
    return info.drop("stands"), stash(cuts)


def union_of(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of flat (start, end) spans, as rows."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([pairs[first, 0], np.append(reach[first[1:] - 1], reach[-1])], axis=1)


def cut_texts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """What is left of texts that lose a part: doc_id, tag, spans (maximal runs, flat), kept (bytes)."""
    def read(batches):
        for batch in batches:
            spans, kept = [], []
            for text, flat in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, runs = (text or "").encode(), union_of(np.array(flat, np.int64))
                keep, at = [], 0
                for a, b in runs.tolist():
                    keep.append(raw[at:a])
                    at = b
                spans.append(runs.ravel().tolist())
                kept.append(b"".join([*keep, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "tag", "spans", "kept"])

    return with_text(docs, cuts).select("doc_id", "tag", "text", "spans").mapInArrow(read, f"doc_id {_kind(docs)}, tag int, spans array<long>, kept binary")
