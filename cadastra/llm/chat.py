"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant and all others as named users; only the speaker's own
turns are trained on. System turns stay system turns and are no participant.

A rendering is returned turn by turn, with each turn's place in the rendered
text. Turns are range-sorted by conversation, perspective and order, so one
dialogue of any length spreads over parts; running sums within a part need only
the sums of earlier parts for the part's first dialogue.

Defined cases: a null role is the speaker `unknown`; a null text is empty; a
null turn comes first; turns that tie are ordered by role, then text, and equal
rows are all rendered; a mark of the format within a text or a name gets a space
("<| im_end|>") and a line break within a name is a space, so that no text can
open or close a turn; rows without conv_id belong to no dialogue and are left
out; a dialogue of system turns alone has no perspective; texts of any length are
rendered whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm._io import Scratch, small_batches

#: The turns of a conversation are dealt to so many tasks for the rendering.
SALTS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_PLACED = "conv_id {0}, perspective string, turn long, seat string, rendered string, head int, size long, part int, ahead long"


def plain(text: Column) -> Column:
    """Text without marks of the format."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the part, and the characters ahead of each row within its dialogue in this part."""
    part, last, ahead = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(0), batch.column(1)]
        new = np.ones(batch.num_rows, bool)
        for k, column in enumerate(keys):
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = differs if k == 0 else new[1:] | differs
        first = tuple(c[0].as_py() for c in keys)
        new[0], start = first != last, 0 if first != last else ahead
        size = batch.column(6).to_numpy(zero_copy_only=False)
        before = np.cumsum(size) - size
        begin = np.flatnonzero(new)
        offset = np.concatenate([[-start], before[begin]])[np.cumsum(new)] if not new[0] else before[begin][np.cumsum(new) - 1]
        out = before - offset
        last, ahead = tuple(c[len(c) - 1].as_py() for c in keys), int(out[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(out), part, np.int32)), pa.array(out.astype(np.int64))], names=[*batch.schema.names, "part", "ahead"])


def rotate_perspectives(turns: DataFrame, *, system_role: str = "system") -> DataFrame:
    """One row for each conversation, perspective and turn.

    Columns: conv_id, perspective, turn, seat, rendered, start, end (places in
    the rendered dialogue), mask_start, mask_end (the characters trained on;
    null where the turn is context).
    """
    spark = turns.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "chat")
    rows = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("turn", "role", "text"), F.lit(SALTS)))
    people = rows.where(F.col("role") != system_role).select("conv_id", F.col("role").alias("perspective")).distinct()
    spots = rows.select("conv_id", "salt").distinct().join(people, "conv_id")
    seat = F.when(F.col("role") == F.col("perspective"), "assistant").when(F.col("role") == system_role, "system").otherwise("user")
    name = plain(F.regexp_replace("role", r"[\r\n]", " "))
    head = F.concat(F.lit(OPEN), "seat", F.when(F.col("seat") == "user", F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))
    each = rows.join(spots, ["conv_id", "salt"]).withColumn("seat", seat).withColumn("head", head).withColumn("rendered", F.concat("head", plain(F.col("text")), F.lit(CLOSE)))
    order = ["conv_id", "perspective", "turn", "role", "text"]
    placed = each.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", "perspective", "turn", "seat", "rendered", F.length("head").alias("head"), F.length("rendered").cast("long").alias("size"))
    placed = tmp.save(placed.mapInArrow(_running, _PLACED.format(turns.schema["conv_id"].dataType.simpleString())), "placed")
    key = ["conv_id", "perspective"]
    sums = placed.groupBy(*key, "part").agg(F.sum("size").alias("whole"))
    base = F.sum("whole").over(Window.partitionBy(*key).orderBy("part")) - F.col("whole")
    base = sums.select(*key, "part", base.alias("base")).where("base > 0")  # the first dialogue of a part at most
    start = F.coalesce("base", F.lit(0).cast("long")) + F.col("ahead")
    whole = placed.join(F.broadcast(base), [*key, "part"], "left").withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
    own = F.col("seat") == "assistant"
    return whole.select(*key, "turn", "seat", "rendered", "start", "end", F.when(own, F.col("start") + F.col("head")).alias("mask_start"), F.when(own, F.col("end") - 1).alias("mask_end"))
