"""Chat preference pairs: the common prompt once, and two masked completions. DataFrame and SQL functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The marks around a rendered turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """(_conv, _turn, _k, _role, _text): distinct turns; _k tells apart those that share a turn number."""
    rows = conversations.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.where("_conv is not null and _turn is not null").distinct()
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("_conv", "_turn").orderBy("_role", "_text")))


def preference_segments(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Rows (pair_id, part, turn, seq, role, rendered, loss_mask), one for each turn of a pair.

    conversations: conv_id, turn, role, text. pairs: (pair_id, chosen_id, rejected_id), by default conversation 2n as
    chosen and 2n + 1 as rejected of pair n. A pair lacking either conversation is left out.

    The longest common prefix of turns, equal in place, role and text, is the prompt and comes once (part ``prompt``);
    the turns after it come as ``chosen`` and ``rejected``. A turn is rendered with its role; loss_mask is 1 on assistant
    turns of completions and 0 elsewhere. Concatenated by (turn, seq) the segments of a part are its string; see
    :func:`assemble`. One row is one turn, so a conversation of any length never meets in one task.

    Null role or text counts as empty. A turn that is repeated entirely counts once; different turns of one number follow
    each other by role, then text, and seq numbers them. Rows without conv_id or turn are left out.
    """
    turns = materialize(_turns(conversations), "turns")
    if pairs is None:
        there = turns.select("_conv").distinct().select(F.floor(F.col("_conv") / 2).cast("long").alias("pair_id"), "_conv")
        pairs = there.groupBy("pair_id").agg(F.min("_conv").alias("chosen_id"), F.max("_conv").alias("rejected_id")).where(F.col("chosen_id") != F.col("rejected_id"))
    pairs = materialize(pairs.select("pair_id", "chosen_id", "rejected_id").where("pair_id is not null").distinct(), "pairs")
    sides = [materialize(pairs.join(turns, F.col(f"{side}_id") == F.col("_conv")).select("pair_id", "_turn", "_k", "_role", "_text"), side) for side in ("chosen", "rejected")]
    other = sides[1].select(F.col("pair_id").alias("_p2"), F.col("_turn").alias("_t2"), F.col("_k").alias("_k2"), F.col("_role").alias("_r2"), F.col("_text").alias("_x2"))
    same = (F.col("pair_id") == F.col("_p2")) & (F.col("_turn") == F.col("_t2")) & (F.col("_k") == F.col("_k2")) & (F.col("_role") == F.col("_r2")) & (F.col("_text") == F.col("_x2"))
    # a turn without an equal one on the other side ends the prefix
    lone = [sides[0].join(other, same, "left_anti").select("pair_id", "_turn", "_k")]
    mine = sides[0].select(F.col("pair_id").alias("_p1"), F.col("_turn").alias("_t1"), F.col("_k").alias("_k1"), F.col("_role").alias("_r1"), F.col("_text").alias("_x1"))
    lone.append(sides[1].join(mine, (F.col("pair_id") == F.col("_p1")) & (F.col("_turn") == F.col("_t1")) & (F.col("_k") == F.col("_k1")) & (F.col("_role") == F.col("_r1")) & (F.col("_text") == F.col("_x1")), "left_anti").select("pair_id", "_turn", "_k"))
    ends = lone[0].unionByName(lone[1]).groupBy("pair_id").agg(F.min(F.struct("_turn", "_k")).alias("_end"))
    ends = materialize(ends.select(F.col("pair_id").alias("_pe"), F.col("_end._turn").alias("_et"), F.col("_end._k").alias("_ek")), "prefix-ends")
    both = sides[0].withColumn("_side", F.lit("chosen")).unionByName(sides[1].withColumn("_side", F.lit("rejected")))
    placed = both.join(ends, F.col("pair_id") == F.col("_pe"), "left")
    common = F.col("_et").isNull() | (F.col("_turn") < F.col("_et")) | ((F.col("_turn") == F.col("_et")) & (F.col("_k") < F.col("_ek")))
    placed = placed.withColumn("part", F.when(common, F.lit("prompt")).otherwise(F.col("_side"))).where((F.col("part") != "prompt") | (F.col("_side") == "chosen"))
    rendered = F.concat(F.lit(OPEN), F.col("_role"), F.lit(MIDDLE), F.col("_text"), F.lit(CLOSE))
    mask = ((F.col("part") != "prompt") & (F.col("_role") == "assistant")).cast("int")
    return placed.select("pair_id", "part", F.col("_turn").alias("turn"), F.col("_k").alias("seq"), F.col("_role").alias("role"), rendered.alias("rendered"), mask.alias("loss_mask"))


def assemble(segments: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss): a row for each pair.

    A part's segments are joined by (turn, seq). The loss columns list the stretches of a completion that are trained on, the
    assistant's turns, as start:end in characters, comma-joined; the prompt is never trained on. Places are running sums in
    a window. One pair's turns meet in one row, as they must to be one string; pairs are not larger than conversations.
    """
    order = Window.partitionBy("pair_id", "part").orderBy("turn", "seq")
    # dealt by pair once, which serves the window and the groups
    placed = segments.repartition("pair_id").withColumn("_end", F.sum(F.char_length("rendered")).over(order))
    stretch = F.concat_ws(":", (F.col("_end") - F.char_length("rendered")).cast("string"), F.col("_end").cast("string"))
    turn = F.struct("turn", "seq", "rendered", F.when(F.col("loss_mask") == 1, stretch).alias("loss"))
    parts = ("prompt", "chosen", "rejected")
    out = placed.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in parts))
    texts = [F.array_join(F.col(p)["rendered"], "").alias(p) for p in parts]
    losses = [F.array_join(F.col(p)["loss"], ",").alias(f"{p}_loss") for p in parts[1:]]  # nulls are left out
    return out.select("pair_id", F.size("prompt").cast("long").alias("prompt_turns"), *texts, *losses)


def preference_pairs(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row for each pair: its common prompt once and both completions with their masks; see :func:`preference_segments`
    for the pairs, the prefix and odd rows, and :func:`assemble` for the columns. An empty table gives an empty result."""
    return assemble(preference_segments(conversations, pairs))
