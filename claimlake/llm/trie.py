"""Conversation prefix trie: ROLLUP over positional turn-id columns, in blocks of columns.

Every conversation is a row of turn ids for each block of BLOCK turns. A block is keyed by the trie node that the
conversation has reached before it, so `GROUP BY depth, node, ROLLUP(t1 .. tn)` over all blocks of all conversations gives
every prefix at once, whatever the longest conversation; grouping_id tells how many turn columns a group holds.

A node is named by its content: two 64-bit lanes, each the XOR over its turns of hash(lane, position, turn id). A block's
key is then a running XOR, carried over bounded pieces of a conversation, and no block waits for an earlier one. A turn id is
the MD5 of role and text with the text's length in bytes, so texts are read once and never shuffled.

Sums over subtrees need no walk either. A node belongs to its smallest member, and what a conversation owns is the end of
its path. So a subtree's sum is the sum of what its members own, less what its owner owns above it: a second ROLLUP adds up
the members' totals, and a running sum along the owner's path gives the rest.

Hot keys: group counts are partial before they are shuffled; positions and running values in a long conversation are made in
pieces with carried totals; ids that end in one node are joined to texts piece by piece, and only the digest runs over
the pieces in order, one at a time.

Nulls: a null role or text is the empty text, a null turn comes first, rows without conv_id belong to no conversation. Equal
turns of a conversation are ordered by role, then by turn id; repeated rows are turns of their own. A conversation of no turns
(its base is absent and it is shorter than its cut) ends in the root. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimlake.llm.common import stash, text_or_empty
from claimlake.operators.skew import block_positions

#: Turn columns of one ROLLUP.
BLOCK = 8
#: Blocks of a conversation, or owned nodes, that one running window holds.
PIECE = 4096
#: Conversation ids of one piece of a node's list differ by less than this.
ID_PIECE = 1 << 16
#: Turns of another conversation that a conversation can begin with: crc32(id) mod 9 at most.
HEAD = 8


def turn_id(role: Column, text: Column) -> Column:
    """MD5 of the role's length, role and text, and the text's bytes as eight more."""
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def turn_bytes(turn: str) -> str:
    return f"cast(conv(hex(substring({turn}, 17, 8)), 16, 10) as long)"


def carried(df: DataFrame, key: str, order: str, folds: dict[str, Callable[[Column], Column]], at_first: dict[str, object]) -> DataFrame:
    """For each row, `fold` over the earlier rows of its key, as <column>_before: within pieces, with totals of earlier pieces carried."""
    rows = df.withColumn("piece", F.floor(F.col(order) / PIECE))
    totals = rows.groupBy(key, "piece").agg(*[fold(F.col(c)).alias(f"{c}_piece") for c, fold in folds.items()])
    earlier = W.partitionBy(key).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(key, "piece", *[F.array(fold(F.col(f"{c}_piece")).over(earlier)).alias(f"{c}_piece") for c, fold in folds.items()])
    inside = W.partitionBy(key, "piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(totals, [key, "piece"])
    for c, fold in folds.items():
        both = F.array(F.coalesce(F.col(f"{c}_piece")[0], F.lit(at_first[c])), F.coalesce(fold(F.col(c)).over(inside), F.lit(at_first[c])))
        joined = both[0].bitwiseXOR(both[1]) if fold is F.bit_xor else both[0] + both[1]
        rows = rows.withColumn(f"{c}_before", joined).drop(f"{c}_piece")
    return rows.drop("piece")


def turns_of(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id, at (place in its conversation, from 0), id: narrow rows, written once.

    Rows are dealt by ranges of (conv_id, turn, role, id), so a long conversation is many pieces.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    narrow = stash(conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), turn_id(role, text_or_empty()).alias("id")))
    ranges = ranges or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("id")]
    dealt = stash(narrow.repartitionByRange(ranges, F.col("conv_id"), *order).withColumn("range", F.spark_partition_id()))
    return block_positions(dealt, ["conv_id"], F.col("range"), order, "at").select("conv_id", "at", "id")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, p, id: the first h turns of conversation c - c % 5, then c's own after its first h; h is crc32(c) mod 9.

    A conversation without a turn has one row of null p and id.
    """
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).alias("h")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    lead = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEAD)).alias("lead"))
    convs = sizes.select("conv_id", "n", cut, (F.col("conv_id") - F.col("conv_id") % 5).alias("base")).join(lead, "base", "left")
    convs = convs.withColumn("lead", F.least("h", F.coalesce("lead", F.lit(0))))
    heads = turns.filter(F.col("at") < HEAD).select(F.col("conv_id").alias("base"), "at", "id")
    taken = convs.join(heads, "base").filter(F.col("at") < F.col("lead")).select("conv_id", F.col("at").alias("p"), "id")
    own = turns.join(convs.select("conv_id", "h", "lead"), "conv_id").filter(F.col("at") >= F.col("h"))
    own = own.select("conv_id", (F.col("lead") + F.col("at") - F.col("h")).alias("p"), "id")
    empty = convs.filter((F.col("lead") == 0) & (F.col("n") <= F.col("h"))).select("conv_id", F.lit(None).cast("long").alias("p"), F.lit(None).cast("binary").alias("id"))
    return taken.unionByName(own).unionByName(empty)


def _lane(lane: int, place: Column, turn: Column) -> Column:
    return F.when(turn.isNotNull(), F.xxhash64(F.lit(lane), place, turn)).otherwise(F.lit(0).cast("long"))


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: conv_id, block, k1, k2 (node before it), t0 .. (turn ids), e1, e2 (node after it), last."""
    placed = turns.select("conv_id", F.coalesce(F.floor(F.col("p") / BLOCK), F.lit(0)).alias("block"), (F.col("p") % BLOCK).alias("j"), "p", "id")
    placed = placed.withColumns({f"x{i}": _lane(i, F.col("p"), F.col("id")) for i in (1, 2)})
    columns = [F.max(F.when(F.col("j") == j, F.col("id"))).alias(f"t{j}") for j in range(BLOCK)]
    rows = placed.groupBy("conv_id", "block").agg(*columns, F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.max("p").alias("p"))
    rows = carried(rows, "conv_id", "block", {"x1": F.bit_xor, "x2": F.bit_xor}, {"x1": 0, "x2": 0})
    return rows.select(
        "conv_id", "block", F.col("x1_before").alias("k1"), F.col("x2_before").alias("k2"), *[f"t{j}" for j in range(BLOCK)],
        F.col("x1_before").bitwiseXOR(F.col("x1")).alias("e1"), F.col("x2_before").bitwiseXOR(F.col("x2")).alias("e2"), F.coalesce(F.col("p") + 1, F.lit(0)).alias("p"),
    )


def rolled(blocks: DataFrame, totals: dict[str, str]) -> DataFrame:
    """depth, id1, id2, up1, up2 (the node above), bytes (of the last text) and the totals, per prefix."""
    turns = [f"t{j}" for j in range(BLOCK)]
    groups = blocks.sparkSession.sql(
        f"""SELECT block, k1, k2, {", ".join(turns)}, {BLOCK} - bit_count(grouping_id()) AS held, {", ".join(f"{e} AS {n}" for n, e in totals.items())}
        FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP({", ".join(turns)})""",
        blocks=blocks,
    )
    said = sum((F.col(t).isNotNull().cast("int") for t in turns), F.lit(0))
    whole = groups.filter((F.col("held") == said) & ((F.col("held") > 0) | (F.col("block") == 0)))
    place = lambda j: F.col("block") * BLOCK + j
    for i in (1, 2):
        node, above = F.col(f"k{i}"), F.col(f"k{i}")
        for j, t in enumerate(turns):
            step = _lane(i, place(j), F.col(t))
            node = node.bitwiseXOR(step)
            above = above.bitwiseXOR(F.when(F.col("held") > j + 1, step).otherwise(F.lit(0).cast("long")))
        whole = whole.withColumns({f"id{i}": node, f"up{i}": above})
    last = F.coalesce(*[F.expr(turn_bytes(t)) for t in reversed(turns)], F.lit(0))
    return whole.select((F.col("block") * BLOCK + F.col("held")).alias("depth"), "id1", "id2", "up1", "up2", last.alias("bytes"), *totals)


def id_digests(members: DataFrame) -> DataFrame:
    """(id1, id2, conv_id) -> sha256 of each node's ids, ascending, comma-joined; a task holds one piece of one list at a time."""
    pieces = (
        members.groupBy("id1", "id2", F.floor(F.col("conv_id") / ID_PIECE).alias("piece"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, so_far, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (node := (row["id1"], row["id2"])) != at:
                    if at:
                        done.append((*at, so_far.hexdigest()))
                    at, so_far = node, hashlib.sha256()
                else:
                    so_far.update(b",")
                so_far.update(row["ids"].encode())
            yield _digests(done)
            done = []
        yield _digests([(*at, so_far.hexdigest())] if at else [])

    ordered = pieces.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "piece")
    return ordered.mapInArrow(digest, "id1 long, id2 long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (("id1", pa.int64()), ("id2", pa.int64()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = stash(blocks_of(rebuilt(stash(turns_of(conversations)))))
    nodes = stash(rolled(blocks, {"n_convs": "count(*)", "conv_id": "min(conv_id)"}))
    children = nodes.filter(F.col("depth") > 0).groupBy(F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count("*").alias("n_children"))
    nodes = stash(nodes.join(children, ["id1", "id2"], "left").fillna(0, ["n_children"]).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))

    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    members = blocks.join(owned, "conv_id", "left").fillna(0, ["saved", "leaves"])
    below = rolled(members, {"n_leaves": "sum(leaves)", "saved_in": "sum(saved)"}).select("id1", "id2", "n_leaves", "saved_in")
    above = carried(nodes.select("conv_id", "depth", "id1", "id2", "saved"), "conv_id", "depth", {"saved": F.sum}, {"saved": 0}).select("id1", "id2", "saved_before")
    parents = nodes.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    ends = id_digests(blocks.groupBy("conv_id").agg(F.max_by(F.struct("e1", "e2"), "p").alias("e")).select(F.col("e.e1").alias("id1"), F.col("e.e2").alias("id2"), "conv_id"))
    found = nodes.join(below, ["id1", "id2"]).join(above, ["id1", "id2"]).join(ends, ["id1", "id2"], "left")
    inner = found.filter(F.col("depth") > 0).join(parents, ["up1", "up2"])
    root = found.filter(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return inner.unionByName(root).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved_in") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
