"""Score and vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# BM25 and field weights.
SATURATION, LENGTH_NORM = 1.2, 0.75
IDENTIFIER, TITLE, TOPIC, WORKSPACE, KEYWORD, PROJECT, BODY = 4, 3, 2, 3, 2, 1, 1
# Feedback weights, half life in days.
ACTION_WEIGHTS = {"applied": 0.3, "dismiss": -0.25, "pin": 0.4, "useful": 0.15, "wrong": -0.5}
HALF_LIFE_DAYS = 90.0


def idf(documents: Column, frequency: Column) -> Column:
    n = F.greatest(documents, F.lit(1))
    return F.log(F.lit(1.0) + (n - frequency + 0.5) / (frequency + 0.5))


def bm25(tf: Column, length: Column, mean_length: Column, idf_: Column, field_weight: Column) -> Column:
    """Term score plus the field bonus."""
    norm = F.lit(1 - LENGTH_NORM) + LENGTH_NORM * (length / F.greatest(mean_length, F.lit(1.0)))
    return idf_ * (tf * (SATURATION + 1)) / (tf + SATURATION * norm) + field_weight / F.lit(float(IDENTIFIER))


def action_weight(action: Column) -> Column:
    out = F.lit(0.0)
    for name, w in ACTION_WEIGHTS.items():
        out = F.when(action == name, w).otherwise(out)
    return out


def decay(age_days: Column) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / HALF_LIFE_DAYS)


def reciprocal(rank: Column, weight: int) -> Column:
    return F.coalesce(F.floor(F.lit(weight) / rank), F.lit(0))


def global_score(repository_rank: Column, catalog_rank: Column, local_rank: Column, exact: Column, exported: Column) -> Column:
    total = reciprocal(repository_rank, 250) + reciprocal(catalog_rank, 350) + reciprocal(local_rank, 300) + F.when(exact, 80).otherwise(0) + F.when(exported, 20).otherwise(0)
    return F.least(F.lit(1.0), total / F.lit(1000.0))


def squash(score: Column) -> Column:
    """A reranker's score in [0, 1]: as it is inside, a sigmoid outside, 0 for NaN or null."""
    return F.when(score.isNull() | F.isnan(score), 0.0).when(score.between(0, 1), score).otherwise(1 / (1 + F.exp(-score)))


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(21_600_000.0), F.lit(60_000.0) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def is_unit(v: Column, tolerance: float = 0.002) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 where a side has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def quantile_at(values: Column, q: float) -> Column:
    """sorted[min(n - 1, floor(n q))] of an array."""
    n = F.size(values)
    return F.try_element_at(F.array_sort(values), F.least(n, F.floor(n * q).cast("int") + 1))
