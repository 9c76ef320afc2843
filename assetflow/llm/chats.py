"""Operator 3: collapse of cumulative conversation snapshots, and rendering. DataFrame functions only.

A conversation is its distinct turns in the order of (turn, role, text), nulls first; a repeated row counts once
and turn numbers matter only for the order. Each turn gets a rolling hash of the conversation so far. A
conversation is dropped if a longer one begins with all of it, or if an equal one has a smaller conv_id (a null
conv_id is the smallest). What is left is rendered.

Rows with a null conv_id belong to no known conversation: each distinct turn of theirs is a conversation of its own,
of one turn. A null role or text renders as an empty one, but differs from an empty one when compared. Markers of the
format in a text are escaped. An empty table gives no rows. Other columns of the input are not carried.

Turns are dealt out in ranges of the order, which are written to the shared folder, with counts, sizes and hashes
carried from range to range. Only turns of one conversation that agree in turn number, role and the first
``KEY_CHARS`` characters of their text (of all of it, if the role is longer than that) are never parted. Conversations
are rendered in parts: a part's turns begin in the same ``PART_BYTES`` bytes of the rendered conversation and the same
``SLICE_TURNS`` turns. ``part`` is the position of its first turn and tells the order.

``conversations`` joins the parts: one row and one whole text for each conversation, which has to fit a cell (Spark's
limit is 2 GB) and the memory of a task. There a null conv_id is the greatest, so that a turn without one never stands
for an equal conversation that has one. ``collapse`` leaves each part a row of its own, for conversations of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.operators.skew import lookup_join
from assetflow.session import shared_dir

SLICE_TURNS = 4096
PART_BYTES = 8_000_000
KEY_CHARS = 256
PARTS = ("conv_id", "n_turns", "n_copies", "part", "text")


def rendered_turn(role: Column, text: Column) -> Column:
    def clean(c: Column) -> Column:
        return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<\\|"))

    return F.concat(F.lit("<|"), clean(role), F.lit("|>\n"), clean(text), F.lit("\n<|end|>\n"))


def _in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``range`` that rises with the order of (conv_id, turn, role, text)."""
    long_role = F.coalesce(F.length("role") > KEY_CHARS, F.lit(False))
    head = F.when(~long_role, F.left("text", F.lit(KEY_CHARS)))
    ranged = rows.repartitionByRange("conv_id", "turn", F.left("role", F.lit(KEY_CHARS)), long_role, head).withColumn("range", F.spark_partition_id())
    path = shared_dir(rows.sparkSession, "turns")
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def _hashed(placed: DataFrame) -> DataFrame:
    what = (F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text"), F.col("position"))
    return placed.withColumn("h1", F.xxhash64(F.lit(1), *what)).withColumn("h2", F.xxhash64(*what, F.lit(2)))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text, and of the turns up to this one the rendered bytes (up_to) and the hash (p1, p2).

    Of rows with a conv_id.
    """
    rows = _in_ranges(turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").distinct())
    rows = rows.withColumn("size", F.octet_length(rendered_turn(F.col("role"), F.col("text"))).cast("long"))
    keys, order = ["conv_id", "range"], Window.partitionBy("conv_id").orderBy("range")
    in_range = Window.partitionBy(*keys).orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sums = sums.select(*keys, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")))
    own = rows.withColumn("own", F.row_number().over(in_range)).withColumn("own_bytes", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
    placed = own.join(sums, keys).withColumn("position", F.col("n_before") + F.col("own")).withColumn("up_to", F.col("bytes_before") + F.col("own_bytes"))
    hashed = _hashed(placed)
    in_ranges = hashed.groupBy(*keys).agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = in_ranges.select(*keys, *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("x1", "x2")))
    running = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    own = hashed.withColumn("r1", F.bit_xor("h1").over(running)).withColumn("r2", F.bit_xor("h2").over(running))
    return own.join(carried, keys).select(
        "conv_id", "position", "role", "text", "size", "up_to", F.col("r1").bitwiseXOR(F.col("x1_before")).alias("p1"), F.col("r2").bitwiseXOR(F.col("x2_before")).alias("p2")
    )


def single_turns(turns: DataFrame) -> DataFrame:
    """The columns of ``prefix_hashes`` for the distinct turns without a conv_id, each by itself."""
    rows = turns.where("conv_id IS NULL").select("conv_id", "turn", "role", "text").distinct().withColumn("position", F.lit(1).cast("long"))
    size = F.octet_length(rendered_turn(F.col("role"), F.col("text"))).cast("long")
    return _hashed(rows).select("conv_id", "position", "role", "text", size.alias("size"), size.alias("up_to"), F.col("h1").alias("p1"), F.col("h2").alias("p2"))


def maximal_conversations(hashes: DataFrame, singles: DataFrame, known_ids: bool = False) -> DataFrame:
    """conv_id, n_turns, n_copies, n_bytes, p1, p2 of the conversations that no other one continues.

    Of equal ones the smallest conv_id; null is the smallest, or the greatest with ``known_ids``.
    """
    prefixes = hashes.select("conv_id", "position", "p1", "p2")
    end = ["position", "p1", "p2"]
    ends = hashes.groupBy("conv_id").agg(F.max(F.struct(*end, "up_to")).alias("end")).select("conv_id", "end.*")
    first = F.min("conv_id") if known_ids else F.min(F.struct("conv_id"))["conv_id"]
    whole = ends.union(singles.select("conv_id", *end, "up_to")).groupBy(*end).agg(
        first.alias("conv_id"), F.count("*").alias("n_copies"), F.max("up_to").alias("n_bytes")
    )
    proper = lookup_join(prefixes, ends.select("conv_id", F.col("position").alias("n")), "conv_id").where("position < n").select(*end).distinct()
    return whole.join(proper, end, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "n_copies", "n_bytes", "p1", "p2")


def _rendered(turns: DataFrame, known_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """The parts of the conversations with a conv_id, and those of the others."""
    hashes, singles = prefix_hashes(turns), single_turns(turns)
    kept = maximal_conversations(hashes, singles, known_ids)
    turn = rendered_turn(F.col("role"), F.col("text"))
    named = kept.where("conv_id IS NOT NULL").select("conv_id", "n_turns", "n_copies")
    own = hashes.select(
        "conv_id", "position", "role", "text",
        F.floor((F.col("up_to") - F.col("size")) / PART_BYTES).alias("by_bytes"), F.floor((F.col("position") - 1) / SLICE_TURNS).alias("by_turns"),
    )
    chosen = lookup_join(own, named, "conv_id")
    # dealt out by part: the join's deal by conv_id would do for the groups, with a whole conversation in one task
    parts = (
        chosen.repartition("conv_id", "by_bytes", "by_turns")
        .groupBy("conv_id", "n_turns", "n_copies", "by_bytes", "by_turns")
        .agg(F.min("position").alias("part"), F.sort_array(F.collect_list(F.struct("position", turn.alias("turn")))).alias("turns"))
        .select("conv_id", "n_turns", "n_copies", "part", F.array_join("turns.turn", "").alias("text"))
    )
    alone = singles.select("role", "text", "p1", "p2").distinct().join(kept.where("conv_id IS NULL"), ["p1", "p2"])
    return parts, alone.select("conv_id", "n_turns", "n_copies", F.col("n_turns").alias("part"), turn.alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations in parts: conv_id, n_turns, n_copies, part (the position of its first turn), text."""
    parts, alone = _rendered(turns)
    return parts.select(*PARTS).union(alone)


def conversations(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation, whatever its size: conv_id, n_turns, n_copies, text (all of it)."""
    parts, alone = _rendered(turns, known_ids=True)
    whole = (
        parts.groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts"))
        .select("conv_id", "n_turns", "n_copies", F.array_join("parts.text", "").alias("text"))
    )
    return whole.union(alone.drop("part"))


SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone,
    '<|' || replace(coalesce(role, ''), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || chr(10) || '<|end|>' || chr(10) AS turn_text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
placed AS (
  SELECT *, row_number() OVER w AS position, sum(strlen(turn_text)) OVER w - strlen(turn_text) AS bytes_before
  FROM turns WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
convs AS (SELECT conv_id, alone, count(*) AS n_turns, list({{'role': role, 'text': text}} ORDER BY position) AS turns FROM placed GROUP BY conv_id, alone),
firsts AS (
  SELECT *, count(*) OVER (PARTITION BY turns) AS n_copies FROM convs
  QUALIFY row_number() OVER (PARTITION BY turns ORDER BY conv_id NULLS FIRST, alone) = 1),
kept AS (
  SELECT * FROM firsts c WHERE NOT EXISTS (
    SELECT 1 FROM convs d WHERE d.conv_id IS NOT NULL AND d.n_turns > c.n_turns AND d.turns[1] = c.turns[1] AND d.turns[1:c.n_turns] = c.turns))
SELECT k.conv_id, k.n_turns, k.n_copies, min(position) AS part, string_agg(turn_text, '' ORDER BY position) AS text
FROM kept k JOIN placed p ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.alone IS NOT DISTINCT FROM p.alone
GROUP BY k.conv_id, k.alone, k.n_turns, k.n_copies, bytes_before // {PART_BYTES}, (position - 1) // {SLICE_TURNS}
"""

CONVERSATIONS_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
convs AS (
  SELECT conv_id, count(*) AS n_turns,
    list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|' || replace(coalesce(role, ''), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|')
      || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM turns GROUP BY conv_id, alone),
firsts AS (SELECT turns, min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies, min(text) AS text FROM convs GROUP BY turns)
SELECT c.conv_id, c.n_turns, c.n_copies, c.text
FROM firsts c
WHERE NOT EXISTS (SELECT 1 FROM convs d WHERE d.n_turns > c.n_turns AND d.turns[1] = c.turns[1] AND d.turns[1:c.n_turns] = c.turns)
"""
