"""SimHash fingerprints with built-in column functions only.

The terms of a text are its pairs of neighbouring lower-cased words (the word itself if there is one), each as
often as it occurs. Every bit of a term's 64-bit hash votes for or against that bit of the fingerprint with
the term's weight, its number of occurrences; a fingerprint bit is 1 if more weight votes for than against.
Two votes share a 64-bit sum (32 bits each), so a text may have 2^32 terms.

Defined cases: a null text is empty; a text without words has fingerprint 0 and equals every other one without;
rows with equal ids stand in the order of their texts' hashes; null ids come first; an empty table gives no
rows; extra columns are ignored. Texts are used whole.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyflow.llm.frames import name_of

BITS = 64
_PAIR = (1 << 32) | 1


def terms(text: Column) -> Column:
    """Hashes of the terms of a text, one per occurrence."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _votes(h: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))).alias(f"v{i}") for i in range(32)]


def _bits() -> Column:
    """The fingerprint from the 32 double sums and the number of terms ``n``."""
    out = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{i}", 32)
        out = out.bitwiseOR(F.when(low * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        out = out.bitwiseOR(F.when(high * 2 > F.col("n"), F.lit((1 << (i + 32)) - (1 << 64) * (i == 31))).otherwise(F.lit(0)).cast("long"))
    return F.when(F.col("n") > 0, out).otherwise(F.lit(0).cast("long"))


def fingerprints(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` columns and the fingerprint (long) of ``text``; ``key`` must name a row. A row's votes are
    added up where its text is; nothing is shuffled if ``rows`` is partitioned by some of ``key``."""
    words = rows.select(*key, terms(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    n = F.size("w")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    one = words.select(*key, F.when(n == 1, F.col("w")).otherwise(pairs).alias("terms"))
    votes = one.select(*key, F.explode_outer("terms").alias("h"))
    return votes.groupBy(key).agg(*_votes("h"), F.count("h").alias("n")).select(*key, _bits().alias("fingerprint"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits of two fingerprints."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _id_ranges(docs: DataFrame, key: str, ranges: int) -> list[int]:
    """Ids that begin ranges of about equally many rows; all occur, the first is the smallest."""
    probes = [i / ranges for i in range(1, ranges)]
    row = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, probes, max(10_000, 10 * ranges)).alias("cuts") if probes else F.lit(None).alias("cuts")).first()
    return [] if row["low"] is None else sorted({row["low"], *(row["cuts"] or [])})


def _range_of(key: Column, starts: list[int]) -> Column:
    """Number of the range of an id: blocks of starts first, then starts within the block."""
    side = max(1, int(len(starts) ** 0.5))
    blocks = [starts[i:i + side] for i in range(0, len(starts), side)]
    heads = F.lit([b[0] for b in blocks])
    block = F.size(F.filter(heads, lambda s: s <= key)) - 1
    whole = F.lit(starts)
    inside = F.size(F.filter(F.slice(whole, block * side + 1, F.lit(side)), lambda s: s <= key)) - 1
    return block * side + inside


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(part, tail, doc_id, text_key, copy, text, next_text): every row with the text of the row of next higher id, the last
    with the first one's. Ids are cut into ranges; the first rows of a range also end the range before (``tail``)."""
    body = F.coalesce(F.col(name_of(text)).cast("string"), F.lit(""))
    rows = docs.select(F.col(name_of(doc_id)).alias("doc_id"), F.coalesce(F.col(name_of(doc_id)).cast("long"), F.lit(-(1 << 63))).alias("place"), body.alias("text"))
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = _id_ranges(rows, "place", ranges)
    if not starts:
        starts = [0]
    part = _range_of(F.col("place"), starts)
    n = len(starts)
    both = rows.withColumn("part", part).withColumn("first", F.get(F.lit(starts), F.col("part")) == F.col("place"))
    ends = F.when(F.col("first"), F.array(F.struct(F.col("part"), F.lit(False).alias("tail")), F.struct(((F.col("part") + n - 1) % n).alias("part"), F.lit(True).alias("tail"))))
    spread = both.select("doc_id", "place", "text", F.explode(F.coalesce(ends, F.array(F.struct(F.col("part"), F.lit(False).alias("tail"))))).alias("e"))
    spread = spread.select("e.part", "e.tail", "doc_id", "place", F.xxhash64("text").alias("text_key"), "text")
    order = Window.partitionBy("part").orderBy("tail", "place", "text_key")
    return spread.select("part", "tail", "doc_id", "place", "text_key", F.row_number().over(order).alias("copy"), "text", F.lead("text").over(order).alias("next_text"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (the second half replaced by the first as many characters of the
    next document) and their likeness, also to the next document's. Texts are shuffled once, by range of id."""
    rows = with_next(docs, doc_id, text)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("part", "tail", "doc_id", "place", "text_key", "copy", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    names = ["part", "tail", "doc_id", "place", "text_key", "copy", "n_chars", "edited_sha256"]
    both = rows.select(*names, F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("t"))
    prints = fingerprints(both.select(*names, "t.edit", "t.text"), [*names, "edit"], "text")
    one = prints.groupBy(*names).agg(F.max(F.when(F.col("edit") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("edit") == 1, F.col("fingerprint"))).alias("other"))
    order = Window.partitionBy("part").orderBy("copy")
    out = one.withColumn("next", F.lead("own").over(order)).filter(~F.col("tail"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.lpad(F.hex("own"), 16, "0").alias("fingerprint"), F.lpad(F.hex("other"), 16, "0").alias("edited_fingerprint"),
                      likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"))


def near(prints: DataFrame, fingerprint: str, radius: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) of all pairs of different fingerprints (long) within ``radius`` bits, a from ``queries`` (by default all, then
    a < b). The bits are cut into radius + 2 blocks; any pair in the radius agrees in two of them, so there is a table for
    every choice of two blocks, keyed by their bits, and pairs meet in the tables. Equal fingerprints count once."""
    blocks = radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), 2):
        m = sum(((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c] for c in chosen)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)

    def tables(df: DataFrame, name: str) -> DataFrame:
        at = F.array(*[F.struct(F.lit(i).alias("table"), F.col("f").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
        return df.select(F.col(fingerprint).cast("long").alias("f")).distinct().select(F.col("f").alias(name), F.explode(at).alias("t")).select(name, "t.*")

    left, right = tables(prints if queries is None else queries, "a"), tables(prints, "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    ordered = F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b")
    return left.join(right, ["table", "key"]).filter(ordered & (distance <= radius)).select("a", "b", distance.alias("distance")).distinct()
