"""Shared plumbing of the training-data operators: partition counts, and the library's durable intermediates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialize, shared_dir

__all__ = ["input_bytes", "map_rows", "materialize", "partitions", "shared_dir"]


def map_rows(docs: DataFrame, f: Callable) -> DataFrame:
    """``docs.mapInArrow(f)`` that keeps the columns, whatever their names: ``f`` sees them by place."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(f, plain.schema).toDF(*docs.columns)


def partitions(df: DataFrame, mb_each: float = 8.0) -> int:
    """Shuffle width for ``df``: the session's, or more where its estimated bytes ask for it."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, min(200_000, int(input_bytes(df) / (mb_each * 1e6)) + 1))


#: Estimates from here on mean that Catalyst knows no size.
UNKNOWN = 1 << 50


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that ``df`` reads; where it has none, the texts' bytes are counted.

    A projection divides its table's bytes as if every string had 20, so that texts lose most of
    theirs; the tables read count whole where that is more.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    tables = plan.collectLeaves()
    sizes = [int(str(x.stats().sizeInBytes())) for x in (tables.apply(i) for i in range(tables.size()))]
    size = max(int(str(plan.stats().sizeInBytes())), sum(sizes))
    if size >= UNKNOWN and "text" in df.columns:
        size = (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    return min(size, UNKNOWN)
