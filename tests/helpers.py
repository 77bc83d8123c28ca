"""What several test files share."""
from datetime import datetime, timezone

BASE = datetime(2026, 8, 3, 12, 0, 0, tzinfo=timezone.utc)


def rows(frame, *columns):
    """Rows as a sorted list of tuples."""
    frame = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in frame.collect()), key=repr)
