"""Conversations and logged answer streams as tables: a row per turn, a row per piece of an answer.

No row grows with the length of a conversation or an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.schemas import SILENT_RESPONSE_EVENTS

_PART = "array<struct<type string, text string>>"


def conversation_history(turns: DataFrame) -> DataFrame:
    """The message (role and text content, as JSON) of each turn of each conversation."""
    message = F.struct(
        "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")
    )
    return turns.select("conv_id", "turn", F.to_json(message).alias("message"))


def history_parts(turns: DataFrame) -> DataFrame:
    """(conv_id, position, part): parts that, joined in order of position, are a conversation's message array.

    The array itself may be too long for a row. Turns are ordered by number, equal ones by message.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "message")
    placed = conversation_history(turns).select(
        "conv_id", "message", F.row_number().over(order).alias("position"), F.lead(F.lit(1)).over(order).isNull().alias("last")
    )
    opens = F.when(F.col("position") == 1, "[").otherwise(",")
    return placed.select("conv_id", "position", F.concat(opens, "message", F.when(F.col("last"), "]").otherwise("")).alias("part"))


def content_text(data: Column) -> Column:
    """Text carried by one logged payload, whichever of its four shapes it has."""
    payload = F.try_parse_json(data)

    def texts(path: str) -> Column:
        as_list = F.try_variant_get(payload, path, _PART)
        said = F.filter(as_list, lambda p: p["type"] == "text")
        return F.array_join(F.transform(said, lambda p: p["text"]), "")

    single = F.try_variant_get(payload, "$.delta.content", "struct<type string, text string>")
    choices = F.try_variant_get(payload, "$.choices", "array<struct<delta struct<content variant>>>")

    def is_text(value: Column) -> Column:
        return F.schema_of_variant(value) == "STRING"

    plain_choices = F.filter(choices, lambda c: is_text(c["delta"]["content"]))
    spoken = F.transform(
        plain_choices, lambda c: F.try_variant_get(c["delta"]["content"], "$", "string")
    )
    top = F.try_variant_get(payload, "$.text", "variant")
    empty = F.lit("")
    return F.concat(
        F.coalesce(texts("$.delta.content"), empty),
        F.coalesce(F.when(single["type"] == "text", single["text"]), empty),
        F.coalesce(F.array_join(spoken, ""), empty),
        F.coalesce(F.when(is_text(top), F.try_variant_get(top, "$", "string")), empty),
        F.coalesce(texts("$.content"), empty),
    )


def answer_text(log: DataFrame) -> DataFrame:
    """The pieces of each answer (response_id, seq, text, error), silent event types left out.

    Pieces in order of ``seq`` make up the answer. An error event stands in for the whole answer:
    then its message is the only piece, and of several errors the first counts.
    """
    heard = log.where(~F.col("event_type").isin(SILENT_RESPONSE_EVENTS))
    message = F.try_variant_get(F.try_parse_json("data"), "$.message", "string")
    failed = heard.where(F.col("event_type") == "error")
    first = failed.groupBy("response_id").agg(
        F.min(F.struct("seq", F.coalesce(message, F.lit("")).alias("error"))).alias("first")
    )
    errors = first.select("response_id", "first.seq", F.lit("").alias("text"), "first.error")
    pieces = heard.join(errors.select("response_id"), "response_id", "left_anti").select(
        "response_id", "seq", content_text(F.col("data")).alias("text"), F.lit(None).cast("string").alias("error")
    )
    return pieces.where(F.col("text") != "").unionByName(errors)
