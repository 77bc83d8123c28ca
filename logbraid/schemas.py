"""Schemas of the tables that pass between the stages."""
from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
_MAP = T.MapType(T.StringType(), T.StringType())

LOG_EVENT = _struct(
    ("event_id", _S),
    ("source_system", _S),
    ("origin", _S),
    ("ts", _TS),
    ("level", _S),
    ("message", _S),
    ("identifiers", _MAP),
    ("host", _S),
    ("ingested_at", _TS),
)

EDGE = _struct(
    ("edge_id", _S),
    ("source_event_id", _S),
    ("target_event_id", _S),
    ("relation_type", _S),
    ("confidence", T.DoubleType()),
    ("matched_on", _S),
    ("created_at", _TS),
)

# Raw records, one frame per source. `record_key` tells byte-identical records
# of one origin apart where the source has such a key.
RAW_CLOUDWATCH = _struct(
    ("origin", _S), ("message", _S), ("timestamp_ms", _L), ("log_stream_name", _S), ("record_key", _S)
)
RAW_TOMCAT = _struct(("origin", _S), ("line", _S), ("record_key", _S))
RAW_GCP = _struct(
    ("origin", _S),
    ("message", _S),
    ("payload_type", _S),
    ("timestamp", _S),
    ("severity", _S),
    ("resource_type", _S),
    ("resource_labels", _MAP),
    ("labels", _MAP),
    ("trace", _S),
    ("record_key", _S),
)
RAW_ORACLE = _struct(
    ("origin", _S), ("timestamp", _S), ("message", _S), ("module", _S), ("host", _S), ("record_key", _S)
)
RAW_MYSQL = _struct(
    ("origin", _S),
    ("timestamp", _S),
    ("level", _S),
    ("message", _S),
    ("error_code", _S),
    ("subsystem", _S),
    ("record_key", _S),
)
RAW_POSTGRES = _struct(
    ("origin", _S), ("timestamp", _S), ("level", _S), ("pid", _S), ("message", _S), ("record_key", _S)
)

# Exported records as they lie in JSON-lines files.
CLOUDWATCH_EXPORT = _struct(
    ("logGroupName", _S), ("logStreamName", _S), ("timestamp", _L), ("message", _S), ("eventId", _S)
)
GCP_EXPORT = _struct(
    ("logName", _S),
    ("textPayload", _S),
    ("jsonPayload", _S),
    ("protoPayload", _S),
    ("timestamp", _S),
    ("severity", _S),
    ("resource", _struct(("type", _S), ("labels", _MAP))),
    ("labels", _MAP),
    ("insertId", _S),
    ("trace", _S),
)

PROPOSED_LINK = _struct(
    ("bucket_id", _L),
    ("chunk_no", _L),
    ("source_event_id", _S),
    ("target_event_id", _S),
    ("confidence", T.DoubleType()),
    ("root_cause_event_id", _S),
    ("summary", _S),
    ("next_step", _S),
)

_EDGE_RULE = T.ArrayType(
    _struct(("from", _S), ("to", _S), ("relation_type", _S), ("min_confidence", T.DoubleType()))
)
_STEP = _struct(
    ("id", _S),
    ("source", _S),
    ("mode", _S),
    ("wait_ms_before", _L),
    ("http", _struct(("path", _S), ("query", _MAP))),
    ("sql", _struct(("function", _S), ("args", _MAP))),
    ("emits", _struct(("source_system", _S), ("message_contains", _S))),
    ("env", _MAP),
    ("note", _S),
)
SCENARIO = _struct(
    ("case_id", _S),
    ("tier", _S),
    ("outcome_class", _S),
    ("title", _S),
    ("identifier_free", T.BooleanType()),
    ("gated_by_phase3", T.BooleanType()),
    ("expected_stage", _S),
    ("use_llm", T.BooleanType()),
    ("edge_scoring", _S),
    ("steps", T.ArrayType(_STEP)),
    (
        "expected",
        _struct(
            ("edges", _EDGE_RULE),
            ("forbidden_edges", _EDGE_RULE),
            ("incidents", T.ArrayType(_struct(("members", T.ArrayType(_S)), ("grouped", T.BooleanType())))),
        ),
    ),
)
