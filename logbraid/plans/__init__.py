"""Whole runs, put together from the operators."""
from logbraid.plans.batch import run_batch
from logbraid.plans.correlate import CorrelationResult, run_correlation
from logbraid.plans.evaluate import EvaluationResult, run_evaluation

__all__ = ["CorrelationResult", "EvaluationResult", "run_batch", "run_correlation", "run_evaluation"]
