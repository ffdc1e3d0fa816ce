"""Column work on documents in Arrow batches, samples of labelled rows, connected components."""
from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from tallyflow.llm.text import CHUNK_BYTES, chunks
from tallyflow.sources.storage import delete_work, durable, work_path

#: Rows of a few numbers each (about 40 bytes) up to which a table is broadcast, after counting it.
BROADCAST_ROWS = 1_000_000
_SCOPES: list[list[str]] = []


def name_of(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with underscores until no column has that name."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name_of(doc_id)).cast("string"), F.lit(""))) % by


def add_columns(docs: DataFrame, text: str, fields: list[StructField], make: Callable, keep: list[str],
                limit: int = CHUNK_BYTES) -> DataFrame:
    """``keep`` columns of ``docs`` followed by ``fields`` computed from the text. ``make()`` runs once a
    task and returns a function (data, offsets, slice) -> list of Arrow arrays; see ``text.chunks``, which takes ``limit``."""
    hidden = free_name(keep, "text_of_row")
    kept = docs.select(*[F.col(name_of(c)) for c in keep],
                       F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")).alias(hidden))
    schema = StructType(kept.schema.fields[:-1] + fields)

    def run(batches):
        of = make()
        for part, data, offsets in chunks(batches, hidden, limit):
            new = of(data, offsets, part)
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + new, names=schema.names)

    return kept.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, learn: Column,
                    most: int) -> DataFrame:
    """(doc_id, text, label 0/1) of about ``most`` labelled documents at most, drawn by a hash of their ids among
    the rows where ``learn`` holds. A document with several labels has their majority, ties count as 1."""
    known = (labels.select(F.col(name_of(doc_id)).alias("id"), F.col(name_of(label)).cast("double").alias("y"))
             .filter("id IS NOT NULL AND y IS NOT NULL").withColumnRenamed("id", doc_id).filter(learn)
             .groupBy(doc_id).agg((F.avg("y") >= 0.5).cast("int").alias("y_of_row")))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64(F.col(name_of(doc_id)).cast("string")), F.lit(1 << 30)) < int((1 << 30) * most / n))
    few = F.broadcast(known)  # at most about ``most`` ids, by the filter above
    return (docs.select(F.col(name_of(doc_id)), F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")).alias("text_of_row"))
            .join(few, doc_id).select(F.col(name_of(doc_id)), F.col("text_of_row").alias("text"), F.col("y_of_row").alias("label")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared work folder and read it back."""
    path = work_path(df.sparkSession, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def work_tables(spark: SparkSession):
    """Tables written by ``stored`` inside are deleted at the end. What is kept must be stored after it, or be read before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_work(spark, path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``make`` returns and delete the work tables that went into it."""
    path = work_path(spark, name)
    with work_tables(spark):
        made = make()
        made.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(made.schema).parquet(path)


def null_safe_join(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where null equals null; the columns of ``a`` stay."""
    b = b.select(*[F.col(c).alias(f"right_{c}") if c in names else F.col(c) for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"right_{c}")) for c in names]
    for c in on[1:]:
        on[0] = on[0] & c
    return a.join(b, on[0], how).drop(*[f"right_{c}" for c in names])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b), both long: component is the smallest node reachable.
    Every edge hangs its larger node on the smaller one. A round moves an edge from a node to that node's smallest neighbour
    below (paths halve), then leaves every node its smallest neighbour and ties the others to that, until every node but the
    roots hangs on one root. A node with very many others below it on one side never meets them in a join: only nodes that
    hang on another are looked up, by broadcast while they are at most ``BROADCAST_ROWS``. Each round is written before the
    next, and only counts reach the driver."""
    at = durable(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    of_node = Window.partitionBy("a")
    for _ in range(rounds):
        low = durable(at.groupBy("a").agg(F.min("b").alias("m"), (F.min("b") < F.max("b")).alias("several")))
        up = _measured(low.select(F.col("a").alias("node"), F.col("m").alias("above")))
        unsettled = low.filter("several").limit(1).count() or at.join(up, F.col("b") == F.col("node"), "left_semi").limit(1).count()
        if not unsettled:
            break
        moved = (at.join(up, F.col("b") == F.col("node"), "left").select("a", F.coalesce("above", "b").alias("b"))
                 .union(low.select("a", "m")).withColumn("m", F.min("b").over(of_node)))
        at = durable(moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = at.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` (stored, of a few numbers each) to be broadcast in a join if they are at most ``BROADCAST_ROWS``."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def drop_rows(docs: DataFrame, gone: DataFrame, on) -> DataFrame:
    """The rows of ``docs`` for which no row of ``gone`` meets ``on``. ``gone`` holds a few numbers a row: it is stored, counted,
    and broadcast below ``BROADCAST_ROWS``, so that texts do not move; beyond that both sides are shuffled."""
    return docs.join(_measured(stored(gone, "gone")), on, "left_anti")
