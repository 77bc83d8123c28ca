"""The set of active sources."""
from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)

DATABASES = ("oracle", "mysql", "postgres")


def parse_database_entries(entries: Sequence[str]) -> list[tuple[str, str]]:
    """`engine:name` texts as pairs. A malformed entry is reported and skipped; an engine that
    is not supported is an error."""
    pairs = []
    for entry in entries:
        engine, _, name = entry.partition(":")
        if not engine or not name:
            log.warning("skipping malformed database entry %r, expected engine:name", entry)
        elif engine not in DATABASES:
            raise ValueError(f"unsupported database engine: {engine}")
        else:
            pairs.append((engine, name))
    return pairs


def union_with_failures(readers: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """Union of normalized event frames, and the reason for each reader that failed while its frame was set up. The
    others go on; it is an error if none is enabled or all fail."""
    if not readers:
        raise ValueError("no source is enabled")
    frames, failures = [], {}
    for name, reader in readers.items():
        try:
            frames.append(reader())
        except (PySparkException, Py4JError, OSError) as error:
            log.warning("source %s failed: %s", name, error)
            failures[name] = str(error)
    if not frames:
        raise RuntimeError(f"all sources failed: {', '.join(failures)}")
    events = frames[0]
    for frame in frames[1:]:
        events = events.unionByName(frame, allowMissingColumns=True)
    return events, failures


def union_sources(readers: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """The events of `union_with_failures`; what failed is only in the log."""
    return union_with_failures(readers)[0]
