"""Set-similarity join of documents on word shingles with an R-tree over count vectors.

A document is the set of its distinct shingles (hashed to 64 bits). Shingles are hashed into groups; a
set's point is its count per group, and the sum of coordinate minima of two points bounds the overlap of
the sets from above, as it does for the maxima of two boxes of points.

1. Equal sets share a node, so copies count once.
2. Routing to trees. Linked sets differ in at most ``D(n)`` shingles. The hash space is cut into
   more than that many ranges, so two linked sets agree in a whole range at least: range contents are keys. Sizes
   are classed so that both sides use the same cut; a set with too many empty ranges adds the keys of a
   prefix filter. Neighbours in sorted key order are joined to families by connected components.
3. Every family is laid out in order of size and coarse counts and cut into leaves of points of bounded size. Pairs of
   leaves whose boxes allow a link are joined, and the point bound is taken for their points. Texts that share
   a passage meet in step 2 but not here: the components of what the bound leaves are the families of step 4.
4. These are laid out and joined in the same way with the points' sets. Within a pair of leaves the point bound, on
   groups fitted to their sizes, selects pairs, which are compared exactly.
5. Connected components of the links are the result. Tasks of steps 3 and 4 return spanning forests
   (and a number of links for each set), not all pairs.

Sets are equal if their 64-bit shingle hashes are; steps 2 to 4 lose no pair of linked sets.

Defined cases: null and empty texts have an empty set, and are their own component with no link;
a text with fewer words than a shingle is one shingle; copies are linked with each other; a row with a null
id takes part, its component is the smallest known id; repeated rows count as copies; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from tallyflow.llm.frames import add_columns, components, drop_rows, free_name, name_of, stored, stored_alone
from tallyflow.llm.text import chunks, mix, word_hashes, words

BOX, POINT_BOX = 64, 16
LEAF_MEMBERS, LEAF_BYTES = 512, 1 << 20
#: Points are some 30 times smaller than sets, a byte a count, so that their leaves hold more.
POINT_MEMBERS, POINT_BYTES = 4096, 1 << 20
#: Members of families up to which they are broadcast to the texts (about 40 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
_STEP = 1.5
_TURNS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_EDGES: dict[int, np.ndarray] = {}


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = h.size - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(k):
            rolled += h[j:j + n] * _TURNS[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= k:
            x = np.sort(rolled[a:b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(mix((h[a:b] * _TURNS[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def node_of(x: np.ndarray) -> int:
    """A 64-bit number of a set."""
    return int(mix(x.sum(dtype=np.uint64, keepdims=True) * np.uint64(3) + np.uint64(x.size)).view(np.int64)[0])


def _class_of(n: int) -> int:
    c, top = 0, 5.0
    while n > int(top):
        c, top = c + 1, top * _STEP
    return c


def _cuts(parts: int) -> np.ndarray:
    if parts not in _EDGES:
        if len(_EDGES) > 4096:
            _EDGES.clear()
        _EDGES[parts] = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
    return _EDGES[parts]


def keys(x: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: two linked sets that are not equal share one at least."""
    n = x.size
    found = []
    own, lowest = _class_of(n), _class_of(-(-n * percent // 100))
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x ^ _TURNS[20]), dtype=np.uint64)])
    for c in range(lowest, own + 1):
        apart = int(5.0 * _STEP**c) * (100 - percent) // percent  # differing shingles, if the smaller set is of class c
        if not apart:
            continue
        slack = 1 + apart // 25
        parts = apart + 1 + slack
        at = np.concatenate([[0], np.searchsorted(x, _cuts(parts)), [n]])
        full = np.flatnonzero(np.diff(at))
        sig = summed[at[full + 1]] - summed[at[full]]
        found.append(mix(sig + (full.astype(np.uint64) + np.uint64(c << 40)) * _TURNS[21]))
        if parts - full.size > slack:  # too many empty ranges: sets of this kind also meet by prefix
            found.append(mix(x[:n - -(-n * percent // 100) + 1] + np.uint64((c + 1) << 32)))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def points(docs: DataFrame, k: int, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, n_shingles, node, keys) of every document; node is null for an empty set."""
    def make():
        def of(data, offsets, part):
            sets = shingles(data, offsets, k)
            found = [keys(x, percent) for x in sets]
            at = np.concatenate([[0], np.cumsum([f.size for f in found])]).astype(np.int32)
            return [pa.array([x.size for x in sets], pa.int64()), pa.array([node_of(x) if x.size else None for x in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))]
        return of

    fields = [StructField("n_shingles", LongType()), StructField("node", LongType()), StructField("keys", ArrayType(LongType()))]
    return add_columns(_texts(docs, text, doc_id), "text", fields, make, ["doc_id", "text_key"])


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text, text_key): id and text key tell apart rows without an id."""
    rows = docs.select(F.col(name_of(doc_id)).alias("doc_id"), F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from the first node with a key, in the order of (key, node), to the others with it. Keys of any
    frequency are spread, as ranges may end anywhere; a key that runs on is joined to the range before by the ends of ranges."""
    def run(batches):
        from pyspark import TaskContext

        part, head, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            first = first or (int(key[0]), int(node[0]))
            begins = np.append(True, key[1:] != key[:-1])
            lead = node[np.maximum.accumulate(np.where(begins, np.arange(key.size), 0))]
            if head and head[0] == key[0]:
                lead[:int(np.argmin(key == key[0])) or key.size] = head[1]
            head = (int(key[-1]), int(lead[-1]))
            hit = lead != node
            pairs = np.unique(np.stack([lead[hit], node[hit]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), -1))], names=["a", "b", "place"])
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([first[0], head[0]]), pa.array([first[1], head[1]]), pa.array([2 * part, 2 * part + 1])], names=["a", "b", "place"])

    out = stored(rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, place long"), "neighbours")
    ends = out.filter("place >= 0")  # two rows per range
    order = Window.orderBy("place")
    joins = (ends.select(F.lag("a").over(order).alias("k0"), F.lag("b").over(order).alias("n0"), F.col("a").alias("k1"), F.col("b").alias("n1"))
             .filter("k0 = k1 AND n0 <> n1").select(F.col("n0").alias("a"), F.col("n1").alias("b")))
    return out.filter("place < 0").select("a", "b").union(joins).distinct()


def _box(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Counts per group of every set; the group is the top bits of a hash."""
    row = np.repeat(np.arange(len(sets)), [x.size for x in sets])
    group = (np.concatenate(sets) >> np.uint64(64 - (groups.bit_length() - 1))).astype(np.int64)
    return np.bincount(row * groups + group, minlength=len(sets) * groups).reshape(len(sets), groups)


def _groups(n: int) -> int:
    """Groups of a point: about four shingles each, so that the bound tells unlike sets apart."""
    return 1 << int(np.clip(np.ceil(np.log2(max(n, 1) / 4 + 1)), 4, 11))


def _tiles(size: np.ndarray) -> np.ndarray:
    """Numbers of size ranges, each 8 per cent wide."""
    return (np.log(np.maximum(size, 1)) / np.log(1.08)).astype(np.int64)


def _point_groups(size: np.ndarray) -> np.ndarray:
    """Groups of the points of sets: one number for a whole tile, so that leaves hold points of one length."""
    return np.array([_groups(int(1.08**t)) for t in _tiles(size).tolist()], np.int64)


def _places(sets: list[np.ndarray]) -> np.ndarray:
    """Place of every set in the order of its family: by size, then Z-order of the leading bits of four counts."""
    coarse = np.minimum(_box(sets, 4), 0xFFFF)
    z = np.zeros(len(sets), np.int64)
    for bit in range(9, -1, -1):
        for g in range(4):
            z = (z << 1) | ((coarse[:, g] >> (bit + 2)) & 1)
    return (_tiles(np.array([x.size for x in sets], np.int64)) << 40) | z


def _point_leaves(members: DataFrame, k: int) -> DataFrame:
    """Leaves (leaf, family, low, high, box, nodes, sizes, points) of the trees of all families from (family, node, text)."""
    def lay(batches):
        for part, data, offsets in chunks(batches, "text"):
            sets = shingles(data, offsets, k)
            same = np.array([node_of(x) for x in sets]) == part.column("node").to_numpy()
            kept = [x for x, s in zip(sets, same) if s]
            size = np.array([x.size for x in kept], np.int64)
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [part.column("family").filter(pa.array(same)), part.column("node").filter(pa.array(same)), pa.array(_places(kept)), pa.array(size),
                     pa.array([_box([x], g).astype("<u4").tobytes() for x, g in zip(kept, _point_groups(size).tolist())], pa.binary())],
                    names=["family", "node", "place", "size", "point"])

    laid = members.mapInArrow(lay, "family long, node long, place long, size long, point binary")
    laid = laid.repartitionByRange("family", "place", "node").sortWithinPartitions("family", "place", "node")

    def cut(batches):
        from pyspark import TaskContext

        leaf = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush():
            nonlocal held, leaf
            sizes = [h[2] for h in held]
            points = np.stack([np.frombuffer(h[3], "<u4") for h in held])
            box = _coarser(points.astype(np.int64), POINT_BOX).max(0)
            row = ([leaf], [held[0][0]], [min(sizes)], [max(sizes)], [box.tolist()], [[h[1] for h in held]], [sizes], [points.astype("u1" if points.max() < 256 else "<u4").tobytes()])
            held, leaf = [], leaf + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("family", "node", "size", "point"))):
                if held and held[-1][:2] == row[:2]:
                    continue  # the node came by two rows of one id
                if held and (held[-1][0] != row[0] or len(held[-1][3]) != len(row[3]) or len(held) >= POINT_MEMBERS or len(held) * len(row[3]) >= 4 * POINT_BYTES):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    names = ["leaf", "family", "low", "high", "box", "nodes", "sizes", "points"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return laid.mapInArrow(cut, "leaf long, family long, low long, high long, box array<long>, nodes array<long>, sizes array<long>, points binary")


def _coarser(points: np.ndarray, groups: int) -> np.ndarray:
    """Counts of fewer groups, each of neighbouring ones."""
    return points.reshape(len(points), groups, -1).sum(2)


def _points(sizes: list[int], raw: bytes) -> np.ndarray:
    """Points of a leaf, a row each; counts take four bytes where one of them needs more than one."""
    groups = int(_point_groups(np.array(sizes[:1]))[0])
    return np.frombuffer(raw, "u1" if len(raw) == len(sizes) * groups else "<u4").reshape(len(sizes), groups).astype(np.int64)


def near_points(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray | None, b: np.ndarray | None, percent: int):
    """(i, array of j) of points of two leaves, or of one with ``b`` None (then each pair once), whose sets may be linked by the bound."""
    one = b is None
    if one:
        size_b, b = size_a, a
    groups = min(a.shape[1], b.shape[1])
    a, b = _coarser(a, groups), _coarser(b, groups)
    most = max(a.max(), b.max())
    dtype = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64
    order = np.argsort(size_b, kind="stable")
    size, a, b = size_b[order], a.astype(dtype), b[order].astype(dtype)
    for at, i in enumerate(order.tolist() if one else range(len(a))):
        n = int(size_a[i])
        lo = at + 1 if one else int(np.searchsorted(size, -(-n * percent // 100)))
        hi = int(np.searchsorted(size, n * 100 // percent, "right"))
        if lo < hi:
            bound = np.minimum(a[i], b[lo:hi]).sum(1, dtype=np.int64)
            near = np.flatnonzero(bound * (100 + percent) >= percent * (n + size[lo:hi]))
            if near.size:
                yield i, order[near + lo]


def _survivors(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs the bound leaves in leaves and pairs of leaves, as edges (a, b) of a spanning forest. Rows without ``b_sizes`` are single leaves."""
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                v = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                size_a, size_b = np.array(v["a_sizes"], np.int64), None if v["b_sizes"] is None else np.array(v["b_sizes"], np.int64)
                a = _points(v["a_sizes"], v["a_points"])
                b = None if size_b is None else _points(v["b_sizes"], v["b_points"])
                node = np.array(v["a_nodes"] + (v["b_nodes"] or []), np.int64)
                top = np.arange(node.size)
                for i, near in near_points(size_a, a, size_b, b, percent):
                    both = np.append(top[near if b is None else near + len(a)], top[i])
                    lowest = both.min()
                    for t in np.unique(both[both != lowest]):
                        top[top == t] = lowest
                least = np.full(node.size, np.iinfo(np.int64).max)
                np.minimum.at(least, top, node)
                hung = np.flatnonzero(node != least[top])
                yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(least[top[hung]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _leaf_pairs(leaves: DataFrame, body: list[str], percent: int) -> tuple[DataFrame, DataFrame]:
    """Single leaves, and pairs of leaves of a family whose boxes allow a link, with the columns ``body`` of both as a_ and b_."""
    thin = leaves.select("leaf", "family", "low", "high", "box")
    a, b = (thin.select(*[F.col(c).alias(f"{side}_{c}") for c in thin.columns]) for side in "ab")
    shared = F.aggregate(F.zip_with("a_box", "b_box", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = (a.join(b, (F.col("a_family") == F.col("b_family")) & (F.col("a_leaf") < F.col("b_leaf"))
                    & (F.col("a_low") * percent <= F.col("b_high") * 100) & (F.col("b_low") * percent <= F.col("a_high") * 100))
             .filter(shared * (100 + percent) >= percent * (F.col("a_low") + F.col("b_low"))).select("a_leaf", "b_leaf"))
    left, right = (leaves.select(F.col("leaf").alias(f"{side}_leaf"), *[F.col(c).alias(f"{side}_{c}") for c in body]) for side in "ab")
    single = left.drop("a_leaf").select("*", *[F.lit(None).cast(leaves.schema[c].dataType).alias(f"b_{c}") for c in body])
    return single, pairs.join(left, "a_leaf").join(right, "b_leaf").drop("a_leaf", "b_leaf")


def _leaves(members: DataFrame, k: int) -> DataFrame:
    """Leaves (leaf, family, low, high, box, nodes, copies, sizes, sets) of the trees of all families from
    (family, node, copies, text)."""
    def lay(batches):
        for part, data, offsets in chunks(batches, "text"):
            sets = shingles(data, offsets, k)
            same = np.array([node_of(x) for x in sets]) == part.column("node").to_numpy()
            keep = pa.array(same)
            yield pa.RecordBatch.from_arrays(
                [part.column("family").filter(keep), part.column("node").filter(keep), part.column("copies").filter(keep),
                 pa.array(_places(sets)[same]), pa.array([x.tobytes() for x, s in zip(sets, same) if s], pa.binary())],
                names=["family", "node", "copies", "place", "members"])

    laid = members.mapInArrow(lay, "family long, node long, copies long, place long, members binary")
    laid = laid.repartitionByRange("family", "place", "node").sortWithinPartitions("family", "place", "node")

    def cut(batches):
        from pyspark import TaskContext

        leaf = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size, family = 0, None

        def flush():
            nonlocal held, size, leaf
            sets = [np.frombuffer(h[2], np.uint64) for h in held]
            n = [x.size for x in sets]
            row = ([leaf], [family], [min(n)], [max(n)], [_box(sets, BOX).max(0).tolist()], [[h[0] for h in held]], [[h[1] for h in held]], [n], [b"".join(h[2] for h in held)])
            held, size, leaf = [], 0, leaf + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for f, node, copies, x in zip(*(batch.column(c).to_pylist() for c in ("family", "node", "copies", "members"))):
                if held and held[-1][0] == node and f == family:
                    continue  # the node came by two rows of one id
                if held and (f != family or size + len(x) > LEAF_BYTES or len(held) >= LEAF_MEMBERS):
                    yield flush()
                family = f
                held.append((node, copies, x))
                size += len(x)
        if held:
            yield flush()

    names = ["leaf", "family", "low", "high", "box", "nodes", "copies", "sizes", "sets"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return laid.mapInArrow(cut, "leaf long, family long, low long, high long, box array<long>, nodes array<long>, copies array<long>, sizes array<long>, sets binary")


def _sets(sizes: list[int], raw: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(raw, np.uint64), np.cumsum(sizes)[:-1])


def links_between(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int):
    """Index pairs (i, j) of linked sets of two leaves, or of one with ``b`` None (then i < j): bound by
    summed coordinate minima, then compared exactly. Yields (i, array of j)."""
    other = a if b is None else b
    size_b = np.array([x.size for x in other])
    order = np.argsort(size_b, kind="stable")
    sorted_b = size_b[order]
    groups = _groups(int(np.median(size_b)))
    dtype = np.uint16 if max(size_b.max(), max(x.size for x in a)) < 1 << 16 else np.int64
    ca, cb = _box(a, groups).astype(dtype), _box([other[j] for j in order], groups).astype(dtype)
    flat = np.concatenate([other[j] for j in order])
    at = np.concatenate([[0], np.cumsum(sorted_b)])
    for i, x in enumerate(a):
        n = x.size
        lo, hi = np.searchsorted(sorted_b, -(-n * percent // 100)), np.searchsorted(sorted_b, n * 100 // percent, "right")
        if lo == hi:
            continue
        bound = np.minimum(ca[i], cb[lo:hi]).sum(1, dtype=np.int64)
        near = np.flatnonzero(bound * (100 + percent) >= percent * (n + sorted_b[lo:hi])) + lo
        if b is None:
            near = near[order[near] > i]
        if not near.size:
            continue
        size = sorted_b[near]
        ends = np.cumsum(size)
        cat = flat[np.repeat(at[near] - (ends - size), size) + np.arange(ends[-1])]
        hit = x[np.minimum(np.searchsorted(x, cat), n - 1)] == cat
        common = np.add.reduceat(hit, ends - size, dtype=np.int64)
        linked = order[near[100 * common >= percent * (n + size - common)]]
        if linked.size:
            yield i, linked


def _forest(rows: DataFrame, percent: int) -> DataFrame:
    """Links within leaves and of leaf pairs as (a, b, links): every linked node with the smallest of its group there and
    0 links, and (node, node, links). Rows without ``b_sizes`` are single leaves."""
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                v = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                one = v["b_sizes"] is None
                a = _sets(v["a_sizes"], v["a_sets"])
                b = None if one else _sets(v["b_sizes"], v["b_sets"])
                nodes = v["a_nodes"] + ([] if one else v["b_nodes"])
                copies = np.array(v["a_copies"] + ([] if one else v["b_copies"]))
                links = np.zeros(len(nodes), np.int64)
                root = list(range(len(nodes)))

                def find(i):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, linked in links_between(a, b, percent):
                    linked = linked + (0 if one else len(a))
                    links[i] += copies[linked].sum()
                    links[linked] += copies[i]
                    for j in linked.tolist():
                        x, y = find(i), find(j)
                        if x != y:
                            root[x] = y
                some = np.flatnonzero(links)
                named = np.array(nodes, np.int64)[some]
                lowest: dict[int, int] = {}
                tops = [find(i) for i in some.tolist()]
                for top, node in zip(tops, named.tolist()):
                    lowest[top] = min(node, lowest.get(top, node))
                right = np.array([lowest[top] for top in tops], np.int64)
                left, right = named[named != right], right[named != right]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([left, named])), pa.array(np.concatenate([right, named])),
                                                  pa.array(np.concatenate([np.zeros(left.size, np.int64), links[some]]))], names=["a", "b", "links"])

    return rows.mapInArrow(run, "a long, b long, links long")


def _members(docs: DataFrame, nodes: DataFrame, families: DataFrame, name: str, text: str, doc_id: str) -> DataFrame:
    """(family, node, copies, text) of the first row of every node of ``families``. Repeated rows give it again."""
    few = stored(families.select("node", F.col("component").alias("family")).join(nodes, "node"), name)
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    same = (F.col("first_key") == F.col("text_key")) & F.col("first_id").eqNullSafe(F.col("doc_id"))
    return _texts(docs, text, doc_id).join(few, same).select("family", "node", "copies", "text")


def similar(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: size of its set, smallest id reachable by
    links (100 * intersection >= percent * union), itself included, and the number of rows it is linked with."""
    at = stored(points(docs, k, percent, text, doc_id), "points")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("first")
    nodes = (at.filter("node IS NOT NULL").groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"))
             .select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "copies"))
    rows = at.select(F.explode("keys").alias("key"), "node")
    families = components(_neighbours(rows))
    found = _members(docs, nodes, families, "rough", text, doc_id)
    rough = stored(_point_leaves(found.drop("copies"), k), "points-leaves")
    single, double = _leaf_pairs(rough, ["nodes", "sizes", "points"], percent)
    families = components(stored(_survivors(single, percent).union(_survivors(double, percent)), "survivors"))
    leaves = stored(_leaves(_members(docs, nodes, families, "members", text, doc_id), k), "leaves")
    single, double = _leaf_pairs(leaves, ["nodes", "copies", "sizes", "sets"], percent)
    forest = stored(_forest(single, percent).union(_forest(double, percent)), "forest")
    groups = components(forest.filter("a <> b").select("a", "b"))
    lowest = groups.join(nodes, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = (groups.join(lowest, "component").select("node", "component_id")
             .join(forest.filter("a = b").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node"), "node", "left"))
    of_node = nodes.join(known, "node", "left").select(
        "node", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (at.drop("keys", "text_key").join(of_node, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without all but the one of smallest id of every group of similar texts. Of rows
    with the same id one stays; rows without an id all stay."""
    found = stored_alone(docs.sparkSession, lambda: similar(docs, k, percent, text, doc_id), "similar")
    hidden = free_name(docs.columns, "id_of_row")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(hidden)).distinct()
    kept = drop_rows(docs, gone, F.col(name_of(doc_id)) == F.col(hidden))
    again = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not again:
        return kept
    named = kept.filter(F.col(name_of(doc_id)).isNotNull()).dropDuplicates([doc_id])
    return named.union(kept.filter(F.col(name_of(doc_id)).isNull()))
