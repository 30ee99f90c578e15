"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that participant as the assistant, all
others as users with their names, and a loss mask on the assistant's turns. A dialogue is returned as its
turns: one row for each conversation, perspective and turn, whose ``rendered`` strings, in order of turn (then
speaker, then text), join to the dialogue; so a conversation of any length stays spread over the cluster.
``loss_start`` and ``loss_end`` are the masked-in characters of ``rendered`` (equal where nothing is).

Defined results: speakers in ``context_roles`` (system) are rendered as such in every perspective and are no
participants; a conversation without participants gives no row; null role is the speaker ``unknown``; null text
is empty; null conv_id is one conversation; null turn is kept and stands first; repeated rows stay. Names keep
letters, digits, ``_`` and ``-``; another character becomes ``_x``, its UTF-8 bytes in hex and ``_``, and a ``_x`` of the
speaker's own becomes ``_x5f_x``, so different speakers have different names. ``<|`` in a text becomes ``< |`` so that
it can't pose as a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import aliased

CONTEXT_ROLES = ("system",)


def safe_name(speaker: Column) -> Column:
    """The speaker as a name of letters, digits, ``_`` and ``-``; no two speakers share one."""
    plain = F.replace(speaker, F.lit("_x"), F.lit("_x5f_x"))
    escaped = F.transform(F.split(plain, ""), lambda c: F.when(c.rlike(r"^[A-Za-z0-9_-]?\z"), c).otherwise(F.concat(F.lit("_x"), F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit("_"))))
    return F.when(plain.rlike(r"^[A-Za-z0-9_-]*\z"), plain).otherwise(F.array_join(escaped, ""))


def rotate(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, name, rendered, mask, loss_start, loss_end."""
    speaker = F.coalesce(F.col("role"), F.lit("unknown"))
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = aliased(conversations, conv_id="conv_id", turn="turn", speaker=speaker, text=text)
    who = turns.where(~F.col("speaker").isin(*context_roles)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    both = turns.join(who, turns["conv_id"].eqNullSafe(who["_conv"])).drop("_conv")
    context, own = F.col("speaker").isin(*context_roles), F.col("speaker") == F.col("perspective")
    role = F.when(context, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~context & ~own, safe_name(F.col("speaker")))
    head = F.concat(F.lit("<|im_start|>"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    both = both.withColumns({"role": role, "name": name, "mask": (own & ~context).cast("int")}).withColumn("head", head)
    body = F.concat(F.col("text"), F.lit("<|im_end|>"))
    start = F.char_length("head")
    return both.select(
        "conv_id", "perspective", "turn", "speaker", "role", "name",
        F.concat(F.col("head"), body, F.lit("\n")).alias("rendered"), "mask",
        start.alias("loss_start"), (start + F.when(F.col("mask") == 1, F.char_length(body)).otherwise(0)).alias("loss_end"),
    )


def dialogues(turns: DataFrame, most: int = 1 << 20) -> DataFrame:
    """conv_id, perspective, part, text and masks (start and end of what the loss counts) of rotated dialogues.

    A dialogue of up to ``most`` characters is one part; a longer one is cut between turns, so that a part is no longer than
    that and its last turn. Joined in order, the parts are the dialogue.
    """
    order = W.partitionBy("conv_id", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "rendered")
    before = F.coalesce(F.sum(F.char_length("rendered")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = turns.withColumn("before", before).withColumn("part", F.floor(F.col("before") / most).cast("int"))
    piece = F.struct("before", F.row_number().over(order).alias("nth"), "rendered", "loss_start", "loss_end")
    rows = placed.withColumn("piece", piece).groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    since = F.get("pieces", F.lit(0))["before"]
    shown = F.filter("pieces", lambda p: p["loss_end"] > p["loss_start"])
    masks = F.transform(shown, lambda p: F.struct((p["before"] - since + p["loss_start"]).alias("start"), (p["before"] - since + p["loss_end"]).alias("end")))
    return rows.select("conv_id", "perspective", "part", F.array_join(F.col("pieces")["rendered"], "").alias("text"), masks.alias("masks"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
b AS (SELECT t.conv_id, w.perspective, t.turn, t.speaker, t.text,
  CASE WHEN speaker = 'system' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN speaker <> 'system' AND speaker <> perspective THEN array_to_string(list_transform(string_split(replace(speaker, '_x', '_x5f_x'), ''),
    lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9_-]?') THEN c ELSE '_x' || lower(hex(c)) || '_' END), '') END AS name,
  CAST(speaker <> 'system' AND speaker = perspective AS INTEGER) AS mask
  FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM b)
SELECT conv_id, perspective, turn, speaker, role, name, head || text || '<|im_end|>' || chr(10) AS rendered, mask,
  CAST(length(head) AS INTEGER) AS loss_start, CAST(length(head) + CASE WHEN mask = 1 THEN length(text) + 10 ELSE 0 END AS INTEGER) AS loss_end FROM h
"""
