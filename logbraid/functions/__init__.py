"""Column expressions; all of them stay inside the JVM."""
from logbraid.functions.identifiers import extract_identifiers, extract_level
from logbraid.functions.levels import (
    fold_mysql_level,
    fold_postgres_level,
    gcp_level,
    known_gcp_level,
    known_mysql_level,
    known_postgres_level,
)
from logbraid.functions.text import event_line, flatten_payload, rationale
from logbraid.functions.times import epoch_ms_or_now, floor_tile, iso_text, parse_tomcat_ts, parse_ts_or_now

__all__ = [
    "epoch_ms_or_now",
    "event_line",
    "extract_identifiers",
    "extract_level",
    "flatten_payload",
    "floor_tile",
    "fold_mysql_level",
    "fold_postgres_level",
    "gcp_level",
    "iso_text",
    "known_gcp_level",
    "known_mysql_level",
    "known_postgres_level",
    "parse_tomcat_ts",
    "parse_ts_or_now",
    "rationale",
]
