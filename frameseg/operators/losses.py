"""Loss terms and learning rates as columns; frames with a negative label are ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(on: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(on, value)), F.lit(0.0)) / F.greatest(F.count_if(on), F.lit(1))


def binary_loss(logit: Column, label: Column) -> Column:
    """Aggregate: mean cross-entropy of logits; labels above 1 count as 1."""
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), label.cast("double")))
    return _mean(label >= 0, F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit))))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def class_loss(logits: str, label: Column, classes: int) -> Column:
    """Aggregate: a label below `classes` costs minus the log-probability of its class; the label `classes` ("not class 1, otherwise unknown")
    costs minus the log-probability of all classes but 1; one mean over both."""
    x = F.col(logits)
    others = F.concat(F.slice(x, 1, 1), F.slice(x, 3, classes))
    every = log_sum_exp(x)
    cost = F.when(label == classes, every - log_sum_exp(others)).otherwise(every - F.get(x, label.cast("int")))
    return _mean((label >= 0) & (label <= classes), cost)


def learning_rate(step: Column, base: float = 3e-4, warmup: int = 500, steps: int = 12_000) -> Column:
    """Linear warm-up times half a cosine."""
    return base * F.least(F.lit(1.0), (step + 1) / F.lit(float(warmup))) * 0.5 * (1 + F.cos(F.pi() * step / steps))
