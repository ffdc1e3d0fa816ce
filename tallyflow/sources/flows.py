"""Flow-table sources, table profile and search-trace sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_flows(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               names: list[str] | None = None, quote: str | None = '"',
               encoding: str = "UTF-8") -> DataFrame:
    """Read a CSV flow table.

    Give ``schema`` for any large file: one pass and no inference. Without it the types are
    inferred, which costs an extra scan. ``names`` describes a file without a header; it is a
    list whose features are doubles and whose last entry is the string label, and stands for a
    schema. ``quote=None`` turns quoting off.
    """
    reader = spark.read.option("encoding", encoding).option("quote", quote or "")
    if names is not None:
        if schema is not None:
            raise ValueError("give either schema or names")
        schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names[:-1]]
                              + [T.StructField(names[-1], T.StringType())])
        return reader.schema(schema).csv(path, header=False)
    if schema is not None:
        return reader.schema(schema).csv(path, header=True)
    return reader.csv(path, header=True, inferSchema=True)


def numbered_flow_names() -> list[str]:
    """Column names of the headerless 249-column flow file: the numbers 1 to 249 without 188,
    then the class."""
    return [str(i) for i in range(1, 250) if i != 188] + ["class"]


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, non-null count, min and max as text.

    All columns are measured by a single aggregation, which returns one row; the unpivot then
    works on that row only.
    """
    types = dict(df.dtypes)
    measured = df.agg(*[
        F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.min(F.col(f"`{c}`")).cast("string").alias("lo"),
                 F.max(F.col(f"`{c}`")).cast("string").alias("hi")).alias(f"s{i}")
        for i, c in enumerate(df.columns)
    ])
    entries = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column_name"),
                 F.lit(types[c]).alias("data_type"), F.col(f"s{i}.n").cast("bigint").alias("n_values"),
                 F.col(f"s{i}.lo").alias("min_value"), F.col(f"s{i}.hi").alias("max_value"))
        for i, c in enumerate(df.columns)
    ])
    return measured.select(F.inline(entries))


def write_trace(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append the best value per iteration (columns Iteration, LogLoss) to a trace folder."""
    out = df.select(F.col("Iteration").cast("int"), F.col("LogLoss").cast("double"))
    out.write.mode("append").option("header", True).format(fmt).save(path)


def read_trace(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema("Iteration int, LogLoss double")
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def write_best(df: DataFrame, path: str) -> None:
    """Store the best parameters, one row per parameter, as (parameter, value) text."""
    df.select(F.col("parameter").cast("string"), F.col("value").cast("string")) \
        .write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
