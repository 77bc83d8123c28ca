"""Constants that are part of the correlation semantics."""
from __future__ import annotations

from dataclasses import dataclass, field

# Identifier patterns, in key order. The order decides ties
# between keys whose groups begin at the same event.
IDENTIFIER_PATTERNS: dict[str, str] = {
    "request_id": r"(?:request[_-]?id|req[_-]?id|x-request-id)[=:\s]+([a-zA-Z0-9\-]{8,})",
    "trace_id": r"(?:trace[_-]?id|x-b3-traceid|x-amzn-trace-id)[=:\s]+([a-zA-Z0-9\-]{8,})",
    "user_id": r"(?:user[_-]?id|uid)[=:\s]+([a-zA-Z0-9\-]{3,})",
    "error_code": r"(?:error[_-]?code|err[_-]?code|status)[=:\s]+([A-Z0-9_\-]{2,})",
    "service_name": r"(?:service[_-]?name|svc)[=:\s]+([a-zA-Z0-9\-_.]{2,})",
}

# The sources a record can come from.
SOURCE_SYSTEMS = ("cloudwatch", "tomcat", "gcp_logging", "oracle", "mysql", "postgres")

# Relation types an edge can carry.
ID_MATCH = "id_match"
TIME_WINDOW = "time_window"
SEMANTIC_SIMILARITY = "semantic_similarity"


@dataclass(frozen=True)
class CorrelationConfig:
    # Defaults of the correlation rules.
    id_window_seconds: int = 300
    bucket_seconds: int = 120
    chunk_size: int = 25
    min_confidence: float = 0.55
    identifier_patterns: dict[str, str] = field(default_factory=lambda: dict(IDENTIFIER_PATTERNS))

    # Caps on what is read; without one, all is read.
    max_lines_per_entry: int | None = None
    max_events_per_group: int | None = None
    max_entries: int | None = None

    # Sizing of the Spark jobs; none of these changes a result.
    rows_per_cell: int = 20_000
    fold_limit: int = 4_096
    broadcast_rows: int = 200_000
    edges_per_task: int = 500_000

    def __post_init__(self):
        for name in ("id_window_seconds", "bucket_seconds", "chunk_size", "rows_per_cell", "edges_per_task"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not self.identifier_patterns:
            raise ValueError("identifier_patterns must not be empty")

    @property
    def id_window_us(self) -> int:
        return self.id_window_seconds * 1_000_000

    @property
    def bucket_us(self) -> int:
        return self.bucket_seconds * 1_000_000
