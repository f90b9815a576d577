"""The six set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame

OPERATIONS = {
    "union_all": DataFrame.unionAll,
    "union_distinct": lambda a, b: a.union(b).distinct(),
    "intersect_distinct": DataFrame.intersect,
    "intersect_all": DataFrame.intersectAll,
    "except_distinct": DataFrame.subtract,
    "except_all": DataFrame.exceptAll,
}
