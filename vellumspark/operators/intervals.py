"""Joins of points with intervals by fixed buckets.

Each interval is dealt to the buckets that it touches and each point to its own, so that the join is one of equal
keys: a point meets the edges of its bucket alone, and a key with very many points or intervals lies in many buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import free_column

BUCKET = 64


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """``points`` beside each interval of the same ``keys`` with ``low`` <= ``at`` <= ``high``; ``how`` is inner, left or left_semi.

    Keys that are null meet nothing, nor do points or edges that are; an interval that ends before it begins holds
    nothing; other columns must have different names.  An interval makes one row a bucket that it touches, so ``bucket`` should
    be about as long as the usual interval.
    """
    place = free_column("bucket", points.columns, intervals.columns)
    renamed = {key: free_column(f"{key}_of_interval", points.columns, intervals.columns) for key in keys}
    first, last = F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket)
    dealt = intervals.where(F.col(low) <= F.col(high)).withColumn(place, F.explode(F.sequence(first, last))).withColumnsRenamed(renamed | {place: f"{place}_of_interval"})
    asked = points.withColumn(place, F.floor(F.col(at) / bucket))
    same = [F.col(key) == F.col(renamed[key]) for key in keys] + [F.col(place) == F.col(f"{place}_of_interval")]
    test = (F.col(low) <= F.col(at)) & (F.col(at) <= F.col(high))
    for s in same:
        test = s & test
    found = asked.join(dealt, test, how)
    return found.drop(place, f"{place}_of_interval", *renamed.values())
