"""Logical steps: observations of one (workflow, seq) folded into one step, and capture-order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.operators.skew import block_positions, previous_row, running_max_before
from claimlake.sources.events import LINES_PER_BLOCK


def capture_block() -> Column:
    """Order-preserving block of a log position."""
    return F.struct("source_file", F.floor(F.col("line_no") / LINES_PER_BLOCK).alias("b"))


def logical_steps(observations: DataFrame) -> DataFrame:
    """Last observation in capture order per (workflow, seq), how often it was seen, and divergence.

    Divergent means some observation differs from the last in tool or canonical params, which is
    the same as the group holding two different values: smallest and largest are not equal. All
    aggregates combine map-side, so a hot (workflow, seq) costs one row per map task. Params must be
    canonical JSON text, as parse_events gives it.
    """
    content = F.struct("tool_id", "params")
    return (
        observations.groupBy("workflow_id", "seq")
        .agg(
            F.max(F.struct("source_file", "line_no", "tool_id", "params", "ts")).alias("last"),
            F.count(F.lit(1)).alias("repeat_count"),
            (F.min(content) != F.max(content)).alias("divergent"),
        )
        .select(
            "workflow_id", "seq",
            F.col("last.tool_id").alias("tool_id"),
            F.col("last.params").alias("params"),
            F.col("last.ts").alias("ts"),
            F.col("last.source_file").alias("source_file"),
            F.col("last.line_no").alias("line_no"),
            "repeat_count", "divergent",
        )
    )


def capture_irregular(observations: DataFrame) -> DataFrame:
    """Workflows whose capture order falls below an earlier seq."""
    ranked = running_max_before(observations, ["workflow_id"], capture_block(), ["line_no"], "seq", "max_before")
    return ranked.groupBy("workflow_id").agg(
        F.coalesce(F.bool_or(F.col("seq") < F.col("max_before")), F.lit(False)).alias("capture_irregular"),
        F.count_if(F.col("seq") < F.col("max_before")).alias("late_observations"),
    )


# Seq values per block when neighbours in seq order are compared, and rows of one seq from which it is cut further.
SEQS_PER_BLOCK = 1 << 18
HOT_SEQS = 10_000


def with_seq_block(observations: DataFrame, hot_rows: int = SEQS_PER_BLOCK) -> DataFrame:
    """Observations with `seq_block`, which rises with (seq, capture order) and bounds the rows of a block.

    A block is a range of seq. Where a range holds a seq of more than hot_rows observations, and of more than
    1 / HOT_SEQS of them all, each seq and stretch of log lines in it is a block of its own. There are fewer than
    HOT_SEQS such seqs, the bound of what is broadcast.
    """
    part = F.floor(F.col("seq") / SEQS_PER_BLOCK)
    counted = observations.groupBy("workflow_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    hot = counted.filter((F.col("n") > hot_rows) & (F.col("n") * HOT_SEQS > counted.agg(F.sum("n")).scalar())).select(
        F.col("workflow_id").alias("hot_workflow"), part.alias("hot_part")).distinct()
    joined = observations.join(F.broadcast(hot), (F.col("workflow_id") == F.col("hot_workflow")) & (part == F.col("hot_part")), "left")
    fine = F.struct("seq", "source_file", F.floor(F.col("line_no") / LINES_PER_BLOCK).alias("b"))
    return joined.withColumn("seq_block", F.struct(part.alias("part"), F.when(F.col("hot_part").isNotNull(), fine).alias("fine"))).drop("hot_workflow", "hot_part")


def seq_positions(observations: DataFrame, hot_rows: int = SEQS_PER_BLOCK) -> DataFrame:
    """0-based place of each observation in (seq, capture) order of its workflow."""
    return block_positions(with_seq_block(observations, hot_rows), ["workflow_id"], F.col("seq_block"), ["seq", "source_file", "line_no"], "place").drop("seq_block")


def timestamp_regressions(observations: DataFrame, hot_rows: int = SEQS_PER_BLOCK) -> DataFrame:
    """First adjacent pair, in (seq, capture) order, whose timestamps decrease.

    Unparsable timestamps make the pair pass. Blocks bound the rows of one task, however large a workflow or a seq is.
    """
    stamped = with_seq_block(observations, hot_rows).withColumn("ms", F.unix_millis(F.try_to_timestamp("ts")))
    paired = previous_row(stamped, ["workflow_id"], F.col("seq_block"), ["seq", "source_file", "line_no"], ["seq", "ms"], "prev")
    drops = paired.filter(F.col("prev.ms") > F.col("ms"))
    return drops.groupBy("workflow_id").agg(
        F.min(F.struct(F.col("seq").alias("seq_after"), "source_file", "line_no", F.col("prev.seq").alias("seq_before"))).alias("f")
    ).select("workflow_id", F.col("f.seq_before").alias("seq_before"), F.col("f.seq_after").alias("seq_after"))


def sequence_integrity(observations: DataFrame) -> DataFrame:
    """Per workflow: the two capture-order findings."""
    return (
        capture_irregular(observations)
        .join(timestamp_regressions(observations), "workflow_id", "left")
        .withColumn("timestamp_irregular", F.col("seq_after").isNotNull())
    )
