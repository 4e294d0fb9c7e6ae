"""Scores of trending searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# How volume and recency are weighed, and the decay of recency.
VOLUME_WEIGHT = 0.6
RECENCY_WEIGHT = 0.4
RECENCY_DECAY_MINUTES = 5


def timestamp(c: Column | datetime) -> Column:
    """A TIMESTAMP in the session time zone from a column or a Python value."""
    return (c if isinstance(c, Column) else F.lit(c)).cast("timestamp")


def round4(c: Column) -> Column:
    return F.round(c, 4)


def recency_weight(created_at: Column, as_of: Column | datetime, decay_minutes: float = RECENCY_DECAY_MINUTES) -> Column:
    """``exp(-minutes / decay)``; rows later than ``as_of`` weigh more than 1."""
    micros = F.unix_micros(timestamp(as_of)) - F.unix_micros(timestamp(created_at))
    return F.exp(-(micros / F.lit(60e6)) / F.lit(float(decay_minutes)))


def trend_score(
    volume: Column,
    recency: Column,
    volume_weight: float = VOLUME_WEIGHT,
    recency_weight: float = RECENCY_WEIGHT,
) -> Column:
    return round4(volume * F.lit(volume_weight) + recency * F.lit(recency_weight))
