"""Multi-party perspective rotation: a dialogue once for each speaker, as the assistant among named users.

SQL functions only. A dialogue is kept as a row for each turn with its place in the rendered text, so that one of any
length is never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_totals

#: A turn is OPEN + role + [" name=" + speaker] + newline + text + CLOSE + newline.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Speakers that set the scene: in every perspective with their own role, in none as the assistant.
SCENE = ("system",)


def clean(c: Column) -> Column:
    """Text in which no marker can be mistaken for a turn's: a backslash goes into each."""
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<\\|im_start|>")), F.lit(CLOSE), F.lit("<\\|im_end|>"))


def shown(c: Column) -> Column:
    """A speaker's name as it stands in a turn's head: without markers, on one line."""
    return F.translate(clean(c), "\r\n", "  ")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", scene: tuple[str, ...] = SCENE) -> DataFrame:
    """One row per conversation, perspective and turn.

    conv_id, perspective, position (from 0), turn, speaker, role (assistant, user or a scene's), segment, start and
    end (code points in the perspective's rendered text; the segments in order are that text), mask_start, mask_end
    (the trained part: text and closing mark of the perspective's own turns, else null).

    Neither a text nor a name can open or close a turn: markers in them get a backslash, and line ends in names become
    blanks; speaker and perspective stay as given. A null speaker is `unknown`, a null text empty. Turns go by turn (null first), then speaker and text; equal rows
    are turns of their own. A null conv_id is one conversation. Other columns are not looked at. Turns and speakers meet
    in a join by conversation, whose large partitions the adaptive plan splits; each row of it is a row of the result. Conversations with scene turns alone, and empty
    tables, give no row.
    """
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(speaker, F.lit("unknown")).alias("speaker"), clean(F.coalesce(text, F.lit(""))).alias("text"))
    people = base.where(~F.col("speaker").isin(*scene)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    each = base.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*scene), F.col("speaker")).otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("as_role"), F.when(F.col("as_role") == "user", F.concat(F.lit(" name="), shown(F.col("speaker")))).otherwise(""), F.lit("\n"))
    each = each.withColumn("as_role", role).withColumn("head", head)
    each = each.withColumn("segment", F.concat("head", "text", F.lit(CLOSE + "\n"))).withColumn("chars", F.length("segment")).withColumn("one", F.lit(1))
    placed = running_totals(each, ["conv_id", "perspective"], ["turn", "speaker", "text"], {"position": "one", "start": "chars"}, "rotation")
    trained = F.col("as_role") == "assistant"
    body = F.col("start") + F.length("head")
    return placed.select("conv_id", "perspective", "position", "turn", "speaker", F.col("as_role").alias("role"), "segment", "start", (F.col("start") + F.col("chars")).alias("end"), F.when(trained, body).alias("mask_start"), F.when(trained, body + F.length("text") + len(CLOSE)).alias("mask_end"))
