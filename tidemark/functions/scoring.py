"""Scores and distances as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_of_bytes(c: pd.Series) -> pd.Series:
    """Vectors stored as little-endian 32-bit floats; null and lengths that are no multiple of four give null."""
    return c.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths, empty or all-zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(86400.0)


def recency(age_days: Column, span: float = 30.0) -> Column:
    """Linear from 1 today to 0 after ``span`` days."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - age_days / F.lit(span))


def strength_factor(strength: Column) -> Column:
    return F.lit(0.1) + F.lit(0.9) * strength


def rrf_term(weight: float, rank0: Column, k: int = 60) -> Column:
    return F.lit(weight) / (F.lit(float(k)) + rank0 + F.lit(1.0))


def final_score(rrf: Column, importance: Column, recent: Column, strength: Column) -> Column:
    return rrf * (F.lit(1.0) + F.lit(0.1) * importance + F.lit(0.05) * recent) * strength_factor(strength)


def context_score(importance: Column, age_days: Column, access_count: Column, strength: Column) -> Column:
    age = F.greatest(age_days, F.lit(0.0))
    return (F.lit(0.1) + importance) / (F.lit(1.0) + age / F.lit(7.0)) * (F.lit(1.0) + F.log1p(access_count.cast("double"))) * strength_factor(strength)


def forgetting_strength(created: Column, accessed: Column, access_count: Column, as_of: Column) -> Column:
    """exp(-age / stability), where stability grows with accesses and their recency; never accessed counts as created."""
    age = F.greatest(days_between(as_of, created), F.lit(0.0))
    since = F.greatest(days_between(as_of, F.coalesce(accessed, created)), F.lit(0.0))
    stability = F.lit(1.0) + F.log1p(F.coalesce(access_count, F.lit(0)).cast("double")) / (F.lit(1.0) + since / F.lit(7.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-age / stability)))


def reinforced(strength: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength + F.lit(0.5) * (F.lit(1.0) - strength)))


def backoff_seconds(attempts: Column, base: int = 10, cap: int = 6) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(0)), F.lit(cap)))


def clamp01(c: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def jaccard(shared: Column, size_a: Column, size_b: Column) -> Column:
    return shared / (size_a + size_b - shared)
