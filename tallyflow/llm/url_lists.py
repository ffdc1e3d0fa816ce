"""Temporal list join of captures with dated list entries, with built-in column functions only.

A list is a log of changes (entry, action, category, time). Consecutive changes of an entry bound validity
intervals; an entry is active from an ``add`` to the next change. An entry is a host, which also covers its
subdomains, or a host with a path prefix ending in '/'. A capture is evaluated as of its fetch time: all hosts above
it and path prefixes are its keys, which meet the intervals by key and calendar month, so that a key with a
long history compares a capture with the changes of one month at most. The longest active entry decides.

Defined cases: changes of an entry at the same time count as one, an add wins and then the category last in order; unknown
actions, null entries and null times are ignored; a capture without a host or time is on no list; repeated captures are evaluated each; an
interval ends before its last instant; empty tables give no rows, or captures on no list. Captures of one address and
time are looked up once; a key with many captures is split by Spark's skew join; extra columns of captures are carried along.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyflow.llm.frames import free_name, name_of


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """Hosts above (two labels at least, or the host itself) and prefixes of the path, as list entries."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    parts = F.split(path, "/")
    deep = F.size(parts) - 1
    below = F.when(deep >= 1, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    return F.when(host != "", F.array_distinct(F.concat(above, F.coalesce(below, F.array().cast("array<string>")))))


def intervals(changes: DataFrame, entry: str = "entry", action: str = "action", category: str = "category", at: str = "at") -> DataFrame:
    """(entry, category, valid_from, valid_to) of active entries; valid_to is null while active. Changes are
    reduced to one per entry and time before the entry's history is ordered."""
    kind = F.lower(F.col(name_of(action)).cast("string"))
    log = changes.filter(kind.isin("add", "remove")).select(F.lower(F.col(name_of(entry)).cast("string")).alias("entry"), F.col(name_of(at)).cast("timestamp").alias("at"),
                                                            F.struct((kind == "add").alias("on"), F.col(name_of(category)).cast("string").alias("category")).alias("c"))
    log = log.filter("entry IS NOT NULL AND at IS NOT NULL").groupBy("entry", "at").agg(F.max("c").alias("c"))
    history = Window.partitionBy("entry").orderBy("at")
    return log.select("entry", F.col("c.category").alias("category"), F.col("at").alias("valid_from"), F.lead("at").over(history).alias("valid_to"), F.col("c.on").alias("on")).filter("on").drop("on")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def evaluate(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_at", **names) -> DataFrame:
    """All columns of ``captures`` with listed, list_entry, list_category, listed_from and active_entries as of the fetch time. A result
    column whose name a capture column has gets underscores behind it."""
    columns = captures.columns
    at = F.col(name_of(fetched)).cast("timestamp")
    address = F.col(name_of(url)).cast("string")
    # captures of one address and time have one answer: they meet it by a 128-bit hash of both, which is the same in every run of a task
    one, two = F.xxhash64(address, at), F.xxhash64(F.lit("second"), at, address)
    rows = captures.select(F.struct(*[F.col(name_of(c)) for c in columns]).alias("capture"), one.alias("k1"), two.alias("k2"))
    asked = captures.filter(address.isNotNull() & at.isNotNull()).select(one.alias("k1"), two.alias("k2"), at.alias("at"), host_of(address).alias("host"), path_of(address).alias("path"))
    spans = intervals(changes, **names)
    last = captures.agg(F.max(at)).first()[0]  # open intervals matter up to the last capture
    if last is None:
        spans = spans.filter(F.lit(False))
    end = F.least(F.coalesce("valid_to", F.lit(last).cast("timestamp")), F.lit(last).cast("timestamp"))
    spans = spans.filter(F.col("valid_from") <= F.lit(last).cast("timestamp")).select("*", F.explode_outer(F.sequence(_month(F.col("valid_from")), _month(end))).alias("month"))
    keyed = asked.dropDuplicates(["k1", "k2"]).select("k1", "k2", "at", _month(F.col("at")).alias("month"), F.explode_outer(keys_of(F.col("host"), F.col("path"))).alias("entry"))
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    best = F.struct(F.length("entry").alias("n"), "entry", "category", "valid_from")
    found = keyed.join(spans, ["entry", "month"]).filter(active).groupBy("k1", "k2").agg(F.max(best).alias("b"), F.count(F.lit(1)).alias("hits"))
    out = rows.join(found, ["k1", "k2"], "left")
    new = {"listed": F.col("b").isNotNull(), "list_entry": F.col("b.entry"), "list_category": F.col("b.category"), "listed_from": F.col("b.valid_from"),
           "active_entries": F.coalesce("hits", F.lit(0).cast("long"))}
    return out.select("capture.*", *[c.alias(free_name(columns, name)) for name, c in new.items()])
