"""Hold the rows of an iterative fit for its many passes."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_WORTH_SPREADING = 1_000_000


@contextmanager
def held(df: DataFrame):
    """The rows in memory, spilling to executor disks, spread over all cores. A lost block is
    recomputed from the source. Input that already has a partition per core stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    first = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept = [first]
    try:
        rows = first.count()
        out = first
        if rows > _WORTH_SPREADING and first.rdd.getNumPartitions() < cores:
            out = first.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(out)
        yield out
    finally:
        for k in reversed(kept):
            k.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores if they come in fewer partitions, for work that costs far more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
