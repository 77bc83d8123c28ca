"""Text built from events and links, and payload flattening."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logbraid.functions.times import iso_text

# Payload keys that may hold the readable message, in order.
MESSAGE_KEYS = ("message", "msg", "error", "description")

_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def event_line(
    event_id: Column, source: Column, ts: Column, level: Column, message: Column, max_chars: int | None = None
) -> Column:
    """One line per event; with `max_chars`, only so much of the message."""
    one_line = F.regexp_replace(strip(message), "\n", " ")
    if max_chars is not None:
        one_line = F.substring(one_line, 1, max_chars)
    shown_level = F.coalesce(F.nullif(level, F.lit("")), F.lit("-"))
    return F.concat_ws(" | ", event_id, source, iso_text(ts), shown_level, one_line)


def rationale(summary: Column, root_cause_source: Column, next_step: Column) -> Column:
    """Fixed lines: summary, then the root cause if it is known, then the next step if there is one.
    `root_cause_source` is null when the root cause is not among the chunk's events."""
    root = F.when(root_cause_source.isNotNull(), F.concat(F.lit("\nROOT CAUSE  "), root_cause_source))
    step = strip(F.coalesce(next_step, F.lit("")))
    return F.concat_ws(
        "\n",
        strip(F.coalesce(summary, F.lit(""))),
        root,
        F.when(step != "", F.concat(F.lit("NEXT STEP   "), step)),
    )


def flatten_payload(text_payload: Column, json_payload: Column, proto_payload: Column) -> Column:
    """Struct (message, payload_type) from the three payload forms, each given as text."""
    parsed = F.try_parse_json(json_payload)
    readable = F.lit(None).cast("string")
    for key in reversed(MESSAGE_KEYS):
        value = F.try_variant_get(parsed, f"$.{key}", "variant")
        is_text = F.schema_of_variant(value) == "STRING"
        readable = F.when(is_text, F.try_variant_get(parsed, f"$.{key}", "string")).otherwise(readable)
    as_json = F.coalesce(F.concat_ws(" | ", readable, json_payload), json_payload)
    return (
        F.when(text_payload.isNotNull(), F.struct(text_payload.alias("message"), F.lit("text").alias("payload_type")))
        .when(json_payload.isNotNull(), F.struct(as_json.alias("message"), F.lit("json").alias("payload_type")))
        .when(proto_payload.isNotNull(), F.struct(proto_payload.alias("message"), F.lit("proto").alias("payload_type")))
        .otherwise(F.struct(F.lit("").alias("message"), F.lit("empty").alias("payload_type")))
    )
