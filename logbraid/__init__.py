"""Cross-system log correlation on Spark DataFrames."""
from logbraid.config import CorrelationConfig

__all__ = ["CorrelationConfig"]
