"""Packing of tokenised documents into sequences: large-item matching, then best fit.

Which sequence a piece goes to depends on lengths only. The driver therefore plans on the histogram of
lengths (at most ``capacity`` numbers): pieces above a third of the capacity are matched greedily, the
longest with the longest that still fits, never more than two in a sequence; smaller ones, longest first,
go to the smallest gap that holds them, and open new sequences when none does. The plan says, for runs of
ranks within a length, the sequence and place; pieces are ranked within their length over hash buckets, so
a length that many pieces share is spread, and look their place up in the plan.

Defined cases: a null or empty text is its end id alone; an empty table gives no rows; repeated rows are
packed each; null ids are kept; a document above the capacity is cut into pieces of the capacity, the last
may be shorter. Extra columns are ignored.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyflow.llm.frames import name_of, stored
from tallyflow.llm.text import chunks
from tallyflow.llm.tokens import encoder, with_end

BUCKET_ROWS = 50_000
#: Bytes of text encoded at once. The arrays of a chunk take a multiple of it in every worker, beside the pieces the encoder keeps.
PACK_BYTES = 1 << 20


def cut(batches, tokenizer: str, end: int, capacity: int):
    """The pieces of batches of doc_id and text, a batch of pieces for every ``PACK_BYTES`` of text."""
    for part, data, offsets in chunks(batches, "text", PACK_BYTES):
        ids, at = with_end(*encoder(tokenizer).encode(data, offsets), end)
        size = np.diff(at)
        n = -(-size // capacity)
        row = np.repeat(np.arange(size.size), n)
        piece = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(size[row] - start, capacity)
        raw = memoryview(ids.astype("<u4").tobytes())
        ends = np.concatenate([[0], np.cumsum(length)])
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)),
             pa.array(crc, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document's pieces."""
    rows = docs.select(F.col(name_of(doc_id)).alias("doc_id"), F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: cut(batches, tokenizer, end, capacity),
                           f"doc_id {key}, piece int, start long, length long, ids_crc32 long, ids array<int>")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places for ``counts`` pieces per length: rows (length, first rank, first sequence, pieces a sequence,
    offset), sorted by length and first rank. Each row covers ranks up to the next row of its length."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"length {size} is outside 1..{capacity}")
        left[size] = n
    rank = np.zeros(capacity + 1, np.int64)
    places: list[tuple] = []
    gaps: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def place(size: int, first: int, bins: int, each: int, offset: int) -> None:
        places.append((size, int(rank[size]), first, each, offset))
        rank[size] += bins * each
        left[size] -= bins * each

    def keep(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first, bins))

    lowest = capacity // 3 + 1
    for a in range(capacity, lowest - 1, -1):
        while left[a]:
            top = min(a, capacity - a)
            fits = np.flatnonzero(left[lowest:top + 1]) + lowest if top >= lowest else np.zeros(0, int)
            b = next((int(x) for x in fits[::-1] if x != a or left[a] > 1), 0)
            bins = int(left[a]) if not b else int(left[a]) // 2 if b == a else int(min(left[a], left[b]))
            if b == a:
                place(a, sequences, bins, 2, 0)
            else:
                place(a, sequences, bins, 1, 0)
                if b:
                    place(b, sequences, bins, 1, a)
            keep(capacity - a - b, sequences, bins)
            sequences += bins
    for s in range(min(lowest - 1, capacity), 0, -1):
        while left[s]:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                gap, first, bins = capacity, sequences, -(-int(left[s]) // (capacity // s))
                sequences += bins
            else:
                gap = gaps[i]
                first, bins = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[i]
            each = gap // s
            full = min(bins, int(left[s]) // each)
            if full:
                place(s, first, full, each, capacity - gap)
                keep(gap - each * s, first, full)
            first, bins = first + full, bins - full
            if bins and left[s]:
                some = int(left[s])
                place(s, first, 1, some, capacity - gap)
                keep(gap - some * s, first, 1)
                first, bins = first + 1, bins - 1
            keep(gap, first, bins)
    out = np.array(places, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def place(rows: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, start and length (1 to ``capacity``). ``rows``
    is read three times and must be stored."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots = plan(counts, capacity)
    buckets = 1 + max(counts.values(), default=0) // BUCKET_ROWS
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    of_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "bucket", F.coalesce(F.sum("n").over(of_length), F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = (spread.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("before")).select(*rows.columns, "rank"))
    sent = rows.sparkSession.sparkContext.broadcast(slots)  # size depends on the capacity only

    def run(batches):
        table = sent.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            hit = table[np.searchsorted(keys, (size << 44) + rank, "right") - 1]
            nth = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit[:, 2] + nth // hit[:, 3]), pa.array(hit[:, 4] + nth % hit[:, 3] * size)], names=names)

    schema = rows.schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = 4096, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Stored pieces with their ids, and the place of every piece (without ids)."""
    held = stored(pieces(docs, tokenizer, end, capacity, text, doc_id), "pieces")
    return held, place(held.drop("ids"), capacity)


def sequences(held: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) with the ids of every sequence in place; a sequence has at most the capacity of ids."""
    parts = held.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))
