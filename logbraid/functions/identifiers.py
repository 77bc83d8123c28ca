"""Identifiers and levels found in free text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logbraid.config import IDENTIFIER_PATTERNS

# Fixed value: level words.
LEVEL_PATTERN = r"\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|SEVERE)\b"

# Case-insensitive, with Unicode classes for \s and \b.
_FLAGS = "(?iU)"


#: Words of which an ASCII text must hold one, in any case, to match the fixed pattern of the key. Other texts need no search by pattern.
_WORDS = {"request_id": ("req",), "trace_id": ("trace",), "user_id": ("user", "uid"), "error_code": ("code", "status"), "service_name": ("service", "svc")}


def _first_match(text: Column, key: str, pattern: str) -> Column:
    found = F.regexp_extract(text, _FLAGS + pattern, 1)
    if key not in _WORDS or pattern != IDENTIFIER_PATTERNS.get(key):
        return found
    # Letters beyond ASCII can equal ASCII ones if case is ignored.
    lacks = F.octet_length(text) == F.char_length(text)
    for word in _WORDS[key]:
        lacks &= ~F.lower(text).contains(word)
    return F.when(lacks, F.lit("")).otherwise(found)


def extract_identifiers(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Map from key to the first match of its pattern; a key without a match is absent."""
    patterns = IDENTIFIER_PATTERNS if patterns is None else patterns
    entries = []
    for key, pattern in patterns.items():
        entries += [F.lit(key), _first_match(text, key, pattern)]
    return F.map_filter(F.create_map(*entries), lambda _, value: value != "")


def extract_level(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, _FLAGS + LEVEL_PATTERN, 1)), F.lit(""))
