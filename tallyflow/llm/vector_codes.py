"""Vector codes of one entry per part, found exactly by slicing sorted coordinates and intersecting bit masks.

A codebook keeps, for each dimension, its entries' coordinates in order and, for each place in that order, the mask of the
entries before it. A radius around a coordinate is a range of places, and the entries in it are the exclusive or of two
prefix masks. The radius is the distance to the better of the two entries that stand next to the vector in the dimension of
widest spread, so the nearest entry lies in the range of every dimension: the masks ANDed over all dimensions hold it and
everything as near, and exact integer distances decide among these. Codebooks of over 64 entries use several 64-bit words.

Defined results: rows whose vector is null, of another length than the first kept vector, or with a null, NaN or infinite
component are left out. Null ids are kept and come last when the first codebook is chosen; equal ids are ordered by their
vectors, and every row counts. With fewer vectors than entries the codebook has one entry per vector. An empty table gives
no rows. Components too large for exact 64-bit distances raise an error. Other columns are not read, whatever their names.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyflow.llm.frames import name_of, null_safe_join, stored
from tallyflow.llm.vectors import first_vectors, integer_digest, integer_sums, integers, means_of, whole_rows

#: Rows of a group table that is sent to all executors; a longer one is joined by a shuffle.
FEW = 100_000
_HEX = np.array([f"{i:02x}" for i in range(256)], "S2")


class MaskIndex:
    """Nearest entry of one codebook (entries x dimensions, integers)."""

    def __init__(self, entries: np.ndarray):
        k, d = entries.shape
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        self.prefix = np.zeros((d, k + 1, (k + 63) // 64), np.uint64)
        for place in range(k):
            self.prefix[:, place + 1] = self.prefix[:, place]
            e = order[place]
            self.prefix[np.arange(d), place + 1, e >> 6] |= np.uint64(1) << (e & 63).astype(np.uint64)
        self.widest = int(np.argmax(self.sorted[:, -1] - self.sorted[:, 0]))
        self.by_widest = order[:, self.widest]

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A radius that holds the nearest entry of every vector."""
        place = np.searchsorted(self.sorted[self.widest], x[:, self.widest])
        best = None
        for beside in (place - 1, place):
            e = self.by_widest[np.clip(beside, 0, len(self.entries) - 1)]
            d2 = ((x - self.entries[e]) ** 2).sum(axis=1)
            best = d2 if best is None else np.minimum(best, d2)
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask words (vectors x words) of the entries within ``radius`` in every dimension."""
        masks = np.full((len(x), self.prefix.shape[2]), np.uint64(2**64 - 1))
        for d, (line, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(line, x[:, d] - radius, "left")
            high = np.searchsorted(line, x[:, d] + radius, "right")
            masks &= prefix[high] ^ prefix[low]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of smallest squared distance, the lower one of ties, and that distance."""
        masks = self.candidates(x, self.radius(x))
        best, found = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks[:, e >> 6] & (np.uint64(1) << np.uint64(e & 63)))
            d2 = ((x[rows] - entry) ** 2).sum(axis=1)
            nearer = d2 < best[rows]
            best[rows[nearer]], found[rows[nearer]] = d2[nearer], e
        return found, best


@dataclass
class Codebooks:
    """Integer codebooks (parts x entries x dimensions of a part) over vectors times ``scale``."""
    books: np.ndarray
    scale: float

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def digest(self) -> str:
        return integer_digest(self.books.ravel())

    def finder(self):
        """A function from an Arrow column to (kept rows, integer parts, entries, squared distances); made once a task."""
        indexes = [MaskIndex(b) for b in self.books]
        parts, _, width = self.books.shape

        def of(column: pa.Array):
            rows, x = whole_rows(column, self.dims)
            x = integers(x, self.scale).reshape(len(rows), parts, width)
            found = [index.nearest(x[:, p]) for p, index in enumerate(indexes)]
            return rows, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

        return of


def fit(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = 8, entries: int = 16, rounds: int = 6,
        scale: float = 4096.0) -> Codebooks | None:
    """Codebooks that start at the vectors of smallest id and move to the floor of their means ``rounds`` times. None without vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("a part has 1 to 256 entries")
    first = first_vectors(df, vector, F.col(name_of(vec_id)), 1, None)
    if not first:
        return None
    dims = len(first[0])
    if dims % parts:
        raise ValueError(f"{dims} components do not make {parts} equal parts")
    start = integers(np.array(first_vectors(df, vector, F.col(name_of(vec_id)), entries, dims)), scale)
    width = dims // parts
    books = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    k = books.shape[1]
    for _ in range(rounds):
        model = Codebooks(books, scale)

        def sums(batch, made=[], model=model):
            made or made.append(model.finder())
            _, x, found, _ = made[0](batch.column(0))
            out = np.zeros((parts, k, width + 1), np.int64)
            for p in range(parts):
                for e in range(k):
                    mine = x[found[:, p] == e, p]
                    out[p, e, :width], out[p, e, width] = mine.sum(axis=0), len(mine)
            return out

        total = integer_sums(df, [vector], sums, (parts, k, width + 1))
        books = means_of(total[..., :width], total[..., width], books.astype(object)).astype(np.int64)
    return Codebooks(books, scale)


def encode(df: DataFrame, model: Codebooks, vector: str = "embedding", vec_id: str = "vec_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, ``keep`` columns, code, error) of every kept row: entries of all parts as two hex digits each, squared distance over all parts."""
    carried = df.select(*[F.col(name_of(c)) for c in (vec_id, *keep)])
    schema = StructType(carried.schema.fields + [StructField("code", StringType()), StructField("error", LongType())])
    n = len(schema) - 2

    def run(batches):
        of = model.finder()
        for batch in batches:
            rows, _, found, d2 = of(batch.column(n))
            if rows.size:
                code = np.ascontiguousarray(_HEX[found]).view(f"S{2 * found.shape[1]}").ravel().astype(str)
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns[:n], pa.array(code, pa.string()), pa.array(d2.sum(axis=1), pa.int64())], names=schema.names)

    return df.select(*[F.col(name_of(c)) for c in (vec_id, *keep, vector)]).mapInArrow(run, schema)


def code_errors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", **options) -> DataFrame:
    """Fit codebooks and return (vec_id, code, error, label_error, codebooks_sha256) of every kept row; label_error adds the errors of
    the rows of equal label, nulls together."""
    rows = df.select(F.col(name_of(vec_id)).alias("vec_id"), F.col(name_of(vector)).alias("x"), F.col(name_of(label)).alias("of"))
    model = fit(rows, "x", "vec_id", **options)
    if model is None:
        return rows.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = stored(encode(rows, model, "x", "vec_id", ("of",)), "codes")
    sums = stored(coded.groupBy("of").agg(F.sum("error").alias("label_error")), "code-errors")
    if sums.count() <= FEW:
        sums = F.broadcast(sums)
    return null_safe_join(coded, sums, ["of"]).select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
