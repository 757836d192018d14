"""Dialogues rendered once per participant, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.running import numbered, running_totals

NARRATOR = "system"


def rotated_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per participant of a conversation and turn: conv_id, participant, turn, segment, length, masked, row.

    Every distinct role but ``system`` is a participant. Its own turns read
    ``<|assistant|>``, those of others ``<|user:NAME|>``, system turns stay; each
    segment ends with a line break. A null role is the speaker ``unknown``; null
    text is empty; a null conversation is a conversation. ``body`` is the place
    of the text inside the segment, and only the participant's text is trained on.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    people = rows.filter(F.col("speaker") != NARRATOR).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("participant"))
    pairs = rows.join(people.distinct(), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("speaker") == F.col("participant")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == NARRATOR, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user:"), F.col("speaker"), F.lit("|>\n"))
    )
    return pairs.select(
        "conv_id", "participant", "turn", "speaker", F.concat(head, "body", F.lit("\n")).alias("segment"),
        F.length(head).alias("body_at"), F.length("body").alias("body_length"), own.alias("masked"),
    )


def perspective_dialogues(turns: DataFrame, limit: int = 16384, **columns: str) -> DataFrame:
    """One row per conversation, participant and part: the text and what is trained on.

    A dialogue is cut between turns: a segment belongs to the part in which it
    starts, parts being ``limit`` characters apart, so a row holds at most that
    and one turn however long the conversation is. ``spans`` lists (start,
    length) of the participant's texts in the part, empty texts left out. Turns
    go by number (null first), then speaker and text. A conversation of system
    turns alone, and the empty table, give no rows.
    """
    rows = numbered(rotated_turns(turns, **columns).withColumn("length", F.length("segment").cast("long")))
    order = [F.col("turn"), F.col("speaker"), F.col("segment")]
    placed = running_totals(rows, ["conv_id", "participant"], order, "length", "start")
    piece = F.struct("start", F.col("_row"), "segment", "body_at", "body_length", "masked")
    parts = placed.withColumn("part", F.floor(F.col("start") / limit).cast("int")).groupBy("conv_id", "participant", "part").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"), F.count("*").alias("turns")
    )
    first = F.col("pieces")[0]["start"]
    mine = F.filter("pieces", lambda p: p["masked"] & (p["body_length"] > 0))
    spans = F.transform(mine, lambda p: F.struct(
        (p["start"] - first + p["body_at"]).cast("int").alias("start"), p["body_length"].alias("length")))
    return parts.select(
        "conv_id", "participant", "part", "turns", F.array_join(F.col("pieces.segment"), "").alias("text"),
        spans.alias("spans"),
    )
