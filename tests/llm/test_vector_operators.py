"""Mask codes and bisector clusters against plain integer searches, and odd vectors."""
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import bisector, vector_codes
from tallyflow.llm.vectors import first_vectors, integers, whole_rows

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cluster int, x array<float>"


def plain_nearest(x, entries):
    d2 = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    best = [min(range(len(entries)), key=lambda e: (row[e], e)) for row in d2]
    return best, [int(row[e]) for row, e in zip(d2, best)]


@pytest.mark.parametrize("k,d,spread", [(1, 3, 5), (16, 8, 3), (16, 8, 4000), (64, 2, 6), (65, 4, 50), (200, 3, 7), (7, 1, 2)])
def test_masks_give_the_nearest_entry(k, d, spread):
    rng = np.random.default_rng(k)
    entries = rng.integers(-spread, spread + 1, (k, d))
    x = rng.integers(-2 * spread, 2 * spread + 1, (400, d))
    index = vector_codes.MaskIndex(entries)
    got, d2 = index.nearest(x)
    assert (got.tolist(), d2.tolist()) == plain_nearest(x, entries)
    radius = index.radius(x)
    within = (np.abs(x[:, None] - entries) <= radius[:, None, None]).all(axis=2)
    masks = index.candidates(x, radius)
    for e in range(k):
        assert ((masks[:, e >> 6] >> np.uint64(e & 63) & np.uint64(1)).astype(bool) == within[:, e]).all()


def test_masks_leave_few_candidates():
    rng = np.random.default_rng(5)
    entries = rng.integers(-4000, 4001, (64, 8))
    x = entries[rng.integers(0, 64, 500)] + rng.integers(-100, 101, (500, 8))
    index = vector_codes.MaskIndex(entries)
    masks = index.candidates(x, index.radius(x))
    assert np.bitwise_count(masks).sum() < 500 * 20


@pytest.mark.parametrize("k,d,spread", [(1, 3, 5), (2, 2, 2), (40, 64, 256), (40, 2, 3), (33, 3, 4), (5, 4, 2**27)])
def test_tournament_gives_the_nearest_centroid(k, d, spread):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-spread, spread + 1, (k, d))
    x = rng.integers(-spread, spread + 1, (300, d))
    got, d2 = bisector.Bracket(centroids).assign(x)
    assert (got.tolist(), d2.tolist()) == plain_nearest(x, centroids)


def plain_codes(rows, parts, entries, rounds, scale):
    rows = sorted(rows, key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    cut = [[[math.floor(scale * float(np.float32(v))) for v in r[1][p * width:(p + 1) * width]] for p in range(parts)] for r in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(w, book):
        return min((sum((a - b) ** 2 for a, b in zip(w, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine)]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    out = {}
    for r, c in zip(rows, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out[r[0]] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), r[2]
    errors = {}
    for _, error, label in out.values():
        errors[label] = errors.get(label, 0) + error
    return {(i, code, error, errors[label], digest) for i, (code, error, label) in out.items()}


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """40 vectors of 8 (some equal), and rows that are left out."""
    rng = np.random.default_rng(1)
    rows = [(i * 7 % 41, [float(v) for v in rng.normal(size=8).round(1)], None if i % 5 == 0 else i % 3, "c", 1, None) for i in range(40)]
    rows += [(100 + i, rows[3][1], 2, None, None, None) for i in range(30)]
    out = [(-1, None, 1, "c", 1, None), (-2, [], 1, "c", 1, None), (-3, [1.0] * 7 + [None], 1, "c", 1, None),
           (-4, [1.0] * 7 + [float("nan")], 1, "c", 1, None), (-5, [1.0] * 7 + [float("inf")], 1, "c", 1, None)]
    return rows, spark.createDataFrame(rows + out + [(200, [1.0] * 7, 1, "c", 1, None)], SCHEMA).repartition(3)


def test_codes_equal_a_plain_version(spark, odd_vectors):
    rows, df = odd_vectors
    got = vector_codes.code_errors(df, parts=4, entries=5, rounds=3)
    assert {tuple(r) for r in got.collect()} == plain_codes(rows, 4, 5, 3, 4096)
    one = df.filter("vec_id IN (0, 7, 200)")
    assert vector_codes.code_errors(one, parts=8).count() == 2


def test_null_and_repeated_ids_count_as_rows(spark):
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [5.0, 6.0], None), (3, [0.5, 6.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.code_errors(df, parts=1, entries=2, rounds=1, scale=1.0).collect()
    assert sorted((r["vec_id"] is None, r["code"]) for r in got) == [(False, "00"), (False, "01"), (True, "00"), (True, "00")]
    assert {r["label_error"] for r in got if r["vec_id"] is None} == {sum(r["error"] for r in got if r["vec_id"] is None)}
    assert bisector.clusters(df, F.col("vec_id"), dims=2, k=3, rounds=2).count() == 4


def test_tables_without_vectors(spark, odd_vectors):
    _, df = odd_vectors
    for empty in (df.limit(0), df.filter("vec_id < 0")):
        assert vector_codes.code_errors(empty).collect() == []
        assert bisector.clusters(empty, F.col("vec_id"), dims=8).collect() == []
    assert vector_codes.code_errors(df.limit(0)).columns == vector_codes.code_errors(df, parts=4).columns


def test_sizes_without_exact_distances_are_refused():
    assert integers(np.array([[1e5, -1e-5]]), 4096.0).tolist() == [[409_600_000, -1]]
    with pytest.raises(ValueError):
        integers(np.array([[1e30, 0.0]]), 4096.0)


def test_whole_rows_follow_slices_and_nulls():
    column = pa.array([[1.0, 2.0], None, [3.0], [4.0, None], [5.0, 6.0], [float("nan"), 1.0]], pa.list_(pa.float32()))
    rows, x = whole_rows(column.slice(1), 2)
    assert rows.tolist() == [3] and x.tolist() == [[5.0, 6.0]]


def test_clusters_equal_a_plain_version(spark, odd_vectors):
    rows, df = odd_vectors
    k, rounds = 6, 4
    x = {r[0]: [math.floor(256 * float(np.float32(v))) for v in r[1]] for r in rows}
    centroids = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = {i: near(v)[1] for i, v in x.items()}
        centroids = [[sum(c) // len(mine) for c in zip(*mine)] if (mine := [x[i] for i in x if at[i] == j]) else c for j, c in enumerate(centroids)]
    want = {i: near(v) for i, v in x.items()}
    each = [sum(d for d, j in want.values() if j == c) for c in range(k)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    got = {tuple(r) for r in bisector.clusters(df, order, dims=8, k=k, rounds=rounds).collect()}
    assert got == {(i, j, d, each[j], sum(each), digests[j]) for i, (d, j) in want.items()}


def test_first_vectors_break_ties_by_components(spark):
    df = spark.createDataFrame([(2, [1.0]), (1, [3.0]), (1, [2.0]), (None, [0.0])], "vec_id long, v array<double>")
    assert first_vectors(df, "v", F.col("vec_id"), 9, None) == [[2.0], [3.0], [1.0], [0.0]]
