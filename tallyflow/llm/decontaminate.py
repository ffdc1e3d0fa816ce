"""Benchmark decontamination by templates, with built-in column functions only.

Texts become sequences of words and numbers. Numbers, percentages, amounts of money, units after a number
and names (capitalised inside a sentence) are replaced by typed placeholders, everything else is
lower-cased. Windows of a template are hashed by doubling (pairs, fours, eights) and joined with the
windows of the benchmark's templates. A document holds an item if it has enough of the item's windows and
its placeholders' values follow one substitution: each value of the item stands for one value in the
document, so that re-parameterised questions are found and chance matches of templates are not. Both are asked
of every copy: of the windows of one alignment (place in the document less place in the item), of alignments near
each other, as a value may take the place of a longer one, and of all windows together, for items with text put in
between. A document that holds an item several times with different values so holds it if any copy passes; the row
given is that of the copy with most windows.

Item windows with placeholders in more than half of their places say little by their template. An item that has some is
also searched by the literal windows (lower-cased words and numbers as they stand) of its whole text, judged by
themselves; if it has no other windows, its templates with words in at least a quarter of their places are used too.

A capitalised first word of an item is lower-cased as at the start of a sentence; as it is a name for the template behind a colon,
comma, bracket or quote, the item's first window is searched in that form too, where the word is one more value.

Defined cases: null and empty texts hold nothing; an item of 4 to 7 words has windows of 4; an item of 2 or 3 words
is one literal window of that size; an item of one word is held where it stands alone between sentence ends, as a word
inside a sentence is no copy; items without a word or number are not searched;
rows equal in id and text give one result row an item; rows with a null id are compared too; extra columns
are ignored. No limit applies to lengths, hits a document or documents an item.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyflow.llm.frames import drop_rows, free_name, name_of, null_safe_join, stored, stored_alone

#: Words with what ends the sentence before them, and numbers.
TOKEN = r"(?:[.!?\n][ \t\r\n]*)?\p{L}+|[$€£]?[0-9][0-9.,]*%?"
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day",
         "weeks", "week", "months", "years", "year", "miles", "mile", "feet", "foot", "inches", "inch", "pounds", "dollars", "euros", "cents",
         "meters", "metres", "grams", "kilograms", "liters", "litres", "percent"]
WINDOW, SHORT = 8, 4
#: Alignments up to this or half an item's windows apart may belong to one copy; copies beside each other are further apart.
DRIFT = 3
#: Rows of the item side up to which it is broadcast (24 bytes each); beyond, Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
SLOTS = ["n_slots", "consistent_slots", "changed_slots"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))


def _starts_number(x: Column) -> Column:
    c = F.ascii(x)
    return c.between(48, 57) | c.isin(36, 163, 8364)


def _canonical(x: Column, i: Column, all_: Column) -> Column:
    """The placeholder or lower-cased word of token ``x`` at place ``i`` of ``all_``."""
    c = F.ascii(x)
    plain = F.when((i > 0) & _starts_number(F.get(all_, i - 1)) & x.isin(UNITS), F.lit("<unit>")).otherwise(x)
    number = F.when(F.endswith(x, F.lit("%")), F.lit("<percent>")).when(c.between(48, 57), F.lit("<number>")).otherwise(F.lit("<money>"))
    return (F.when(c.between(97, 122), plain).when(_starts_number(x), number)
            .when(c.isin(10, 33, 46, 63), F.lower(F.regexp_replace(x, r"^[.!?\n][ \t\r\n]*", "")))
            .when((i > 0) & x.rlike(r"^\p{Lu}\p{Ll}"), F.lit("<name>")).otherwise(F.lower(x)))


def _value(x: Column) -> Column:
    """What a placeholder stands for, and what a token is without the sentence end before it and marks behind a number."""
    return F.lower(F.regexp_replace(x, r"^[.!?\n][ \t\r\n]*|[.,]+$", ""))


def _literal(all_: Column) -> Column:
    """Hashes of the values of all tokens."""
    plain = lambda x: F.when(_starts_number(x) | F.ascii(x).isin(10, 33, 46, 63), _value(x)).otherwise(F.lower(x))
    return F.transform(all_, lambda x: F.xxhash64(plain(x)))


def _alone(text: Column) -> Column:
    """Hashes of the values of tokens that stand alone between sentence ends."""
    parts = F.transform(F.split(text, r"[!?\n]+|\.(?![0-9])"), lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)))
    return F.transform(F.filter(parts, lambda x: F.size(x) == 1), lambda x: F.xxhash64(_value(F.get(x, F.lit(0)))))


def template(all_: Column) -> Column:
    return F.transform(all_, lambda x, i: _canonical(x, i, all_))


def _doubled(h: Column, by: int) -> Column:
    """Hashes of windows twice as long from those of windows of ``by``."""
    n = F.size(h) - by
    ahead = F.slice(h, F.lit(by + 1), F.greatest(n, F.lit(0)))
    return F.zip_with(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))), ahead, lambda a, b: F.xxhash64(a, b))


def _with_windows(rows: DataFrame, all_: str, literal: bool) -> DataFrame:
    """Add ``h4`` and ``h8``, hashes of the windows of four and eight template words, or ``l1``, ``l2``, ``l3``, ``l4`` and ``l8`` of values."""
    k = "l" if literal else "h"
    one = _literal(F.col(all_)) if literal else F.transform(F.col(all_), lambda x, i: F.xxhash64(_canonical(x, i, F.col(all_))))
    out = rows.withColumn(f"{k}1", one)
    out = out.withColumn(f"{k}2", _doubled(F.col(f"{k}1"), 1))
    out = out.withColumn(f"{k}4", _doubled(F.col(f"{k}2"), 2))
    out = out.withColumn(f"{k}8", _doubled(F.col(f"{k}4"), 4))
    if not literal:
        return out.drop("h1", "h2")
    n = F.greatest(F.size("l2") - 1, F.lit(0))
    return out.withColumn("l3", F.zip_with(F.slice("l2", F.lit(1), n), F.slice("l1", F.lit(3), n), lambda a, b: F.xxhash64(a, b)))


def item_windows(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item_id, literal, size, item_pos, h, named, n_windows, slots) of the used windows; ``slots`` has place and value of placeholders.
    ``named`` windows are first windows once more, with the first word as a name."""
    rows = items.select(F.col(name_of(item_id)).alias("item_id"), tokens(F.col(name_of(text))).alias("words")).distinct()
    rows = _with_windows(_with_windows(rows, "words", False), "words", True).withColumn("canon", template(F.col("words")))
    length = F.size("words")
    behind = rows.select("item_id", "words", F.concat(F.array(F.lit("x")), "words").alias("behind"))
    behind = _with_windows(behind, "behind", False).select("item_id", "words", F.get("h8", F.lit(1)).alias("named8"), F.get("h4", F.lit(1)).alias("named4"))
    rows = null_safe_join(rows, behind, ["item_id", "words"])
    rows = rows.withColumn("opens", F.when((length > 0) & F.get("words", F.lit(0)).rlike(r"^\p{Lu}\p{Ll}"), _value(F.get("words", F.lit(0)))))
    rows = rows.withColumn("size", F.when(length >= WINDOW, WINDOW).when(length >= SHORT, SHORT).otherwise(length)).filter("size > 0")
    places = F.zip_with(F.col("canon"), F.col("words"), lambda c, w: F.when(F.startswith(c, F.lit("<")), _value(w)))
    # stored, as Spark would put these columns into the lambdas below and compute them for every window
    rows = stored(rows.withColumn("values", places).drop("canon", "words"), "items")

    def windows(h: Column) -> Column:
        def slots(pos: Column) -> Column:
            at = F.transform(F.slice("values", pos + 1, F.col("size")), lambda v, j: F.struct((j + pos).alias("place"), v.alias("value")))
            return F.filter(at, lambda s: s["value"].isNotNull() & (F.col("size") > 1))
        return F.transform(h, lambda x, i: F.struct(i.alias("item_pos"), x.alias("h"), slots(i).alias("slots")))

    def with_slots_up_to(quarters: int) -> Column:
        return F.filter("typed", lambda w: F.size(w["slots"]) * 4 <= F.col("size") * quarters)

    hashes = F.when(F.col("size") == WINDOW, F.col("h8")).when(F.col("size") == SHORT, F.col("h4")).otherwise(F.array().cast("array<bigint>"))
    as_they_stand = F.when(F.col("size") == WINDOW, F.col("l8"))
    for k in (SHORT, 3, 2, 1):
        as_they_stand = as_they_stand.when(F.col("size") == k, F.col(f"l{k}"))
    rows = rows.withColumn("typed", windows(hashes)).withColumn("whole", windows(as_they_stand)).withColumn("plain", with_slots_up_to(2))
    used = F.when(F.size("plain") > 0, F.col("plain")).otherwise(with_slots_up_to(3))
    typed = rows.select("item_id", F.lit(False).alias("literal"), "size", F.explode(used).alias("w"))
    literal = rows.filter((F.col("size") < SHORT) | (F.size("plain") < F.size("typed"))).select("item_id", F.lit(True).alias("literal"), "size", F.explode("whole").alias("w"))
    one = typed.union(literal).select("item_id", "literal", "size", "w.*", F.lit(False).alias("named"))
    first = rows.filter("opens IS NOT NULL").select("item_id", "size", "opens", "named8", "named4", F.explode(F.filter(used, lambda w: w["item_pos"] == 0)).alias("w"))
    slots_named = F.concat(F.array(F.struct(F.lit(0).alias("place"), F.col("opens").alias("value"))), "w.slots")
    first = first.select("item_id", F.lit(False).alias("literal"), "size", "w.item_pos", F.when(F.col("size") == WINDOW, F.col("named8")).otherwise(F.col("named4")).alias("h"),
                         slots_named.alias("slots"), F.lit(True).alias("named"))
    one = one.union(first.filter(F.size("slots") < F.col("size")))
    total = one.groupBy("item_id", "literal").agg(F.countDistinct("item_pos").alias("n_windows"))
    return null_safe_join(one, total, ["item_id", "literal"])


def _copies(hits: DataFrame, by: list[str]) -> DataFrame:
    """Add ``level`` and ``copy``: a hit counts for its alignment, for the run of near alignments it is in if that has others, and for
    all hits of its document and item if those have other runs."""
    by_shift = Window.partitionBy(*by).orderBy("shift")
    rows = hits.withColumn("shift", F.col("pos") - F.col("item_pos"))
    rows = rows.withColumn("gap", F.col("shift") - F.lag("shift").over(by_shift))
    rows = rows.withColumn("run", F.sum(F.when(F.col("gap") > F.greatest(F.lit(DRIFT), F.col("n_windows") / 2), 1).otherwise(0)).over(by_shift))
    run, all_ = Window.partitionBy(*by, "run"), Window.partitionBy(*by)
    rows = rows.withColumn("mixed", F.min("shift").over(run) < F.max("shift").over(run)).withColumn("runs", F.max("run").over(all_))
    as_ = lambda level, copy: F.struct(F.lit(level).alias("level"), copy.cast("long").alias("copy"))
    levels = F.array(as_(0, F.col("shift")), F.when(F.col("mixed"), as_(1, F.col("run"))), F.when(F.col("runs") > 0, as_(2, F.lit(0))))
    return rows.select(*hits.columns, F.explode(F.array_compact(levels)).alias("c")).select(*hits.columns, "c.*")


def matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
            coverage: float = 0.5, consistency: float = 0.75) -> DataFrame:
    """(doc_id, text_key, item_id, matched_windows, n_windows, n_slots, consistent_slots, changed_slots) of documents
    that hold at least ``coverage`` of an item's windows, with ``consistency`` of its placeholders following one substitution."""
    known = stored(item_windows(items, item_text, item_id), "item-windows")
    n = known.count()

    def near(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if n <= BROADCAST_ROWS else side

    body = F.coalesce(F.col(name_of(text)).cast("string"), F.lit(""))
    texts = docs.select(F.col(name_of(doc_id)).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    cut = texts.select("doc_id", "text_key", "text", tokens(F.col("text")).alias("words"))
    kinds = [(r["literal"], r["size"]) for r in known.select("literal", "size").distinct().collect()]  # at most seven
    hits = None
    for literal, size in sorted(kinds):
        hashes = _alone(F.col("text")) if size == 1 else F.col(f"l{size}" if literal else f"h{size}")
        wanted = known.filter((F.col("literal") == literal) & (F.col("size") == size)).select("h", "item_id", "literal", "item_pos", "named", "n_windows")
        # the outer form: for the plain one Spark infers a filter on the array and computes the template twice
        found = (_with_windows(cut, "words", literal).select("doc_id", "text_key", F.posexplode_outer(hashes).alias("pos", "h")).filter("h IS NOT NULL")
                 .join(near(wanted), "h").drop("h"))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = cut.select("doc_id", "text_key", F.lit(0).alias("pos")).join(known.select("item_id", "literal", "item_pos", "named", "n_windows"), F.lit(False))
    hits = stored(hits.distinct(), "hits")
    pair = ["doc_id", "text_key", "item_id"]
    by = [*pair, "literal"]
    found = hits.groupBy(by).agg(F.countDistinct("item_pos").alias("matched_windows"), F.max("n_windows").alias("n_windows"))
    found = stored(found.filter(F.col("matched_windows") >= coverage * F.col("n_windows")), "found")

    copy = [*by, "level", "copy"]
    held_windows = _copies(null_safe_join(hits, found.select(*by), by, "left_semi"), by).groupBy(copy).agg(
        F.countDistinct("item_pos").alias("matched_windows"), F.max("n_windows").alias("n_windows"), F.collect_set(F.struct("pos", "item_pos", "named")).alias("at"))
    copies = stored(held_windows.filter(F.col("matched_windows") >= coverage * F.col("n_windows")), "copies")

    slotted = known.filter(F.size("slots") > 0).select("item_id", "literal", "item_pos", "named", "slots")
    wanted = (null_safe_join(copies.select(*copy, F.explode("at").alias("at")).select(*copy, "at.*"), near(slotted), ["item_id", "literal", "item_pos", "named"])
              .select(*copy, F.explode(F.transform("slots", lambda s: F.struct(s["place"].alias("place"), s["value"].alias("value"),
                                                                               (s["place"] - F.col("item_pos") + F.col("pos")).alias("at")))).alias("s"))
              .distinct().groupBy(copy).agg(F.collect_list("s").alias("wanted")))
    holders = copies.select("doc_id", "text_key").distinct()
    m = holders.count()
    holders = F.broadcast(holders) if m <= BROADCAST_ROWS else holders
    held = null_safe_join(texts, holders, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", tokens(F.col("text")).alias("words"))
    values = null_safe_join(wanted, held, ["doc_id", "text_key"]).select(*copy, F.explode(F.transform("wanted", lambda s: F.struct(
        s["place"].alias("place"), s["value"].alias("value"), _value(F.get("words", s["at"])).alias("other")))).alias("s")).select(*copy, "s.*")
    counted = values.groupBy(*copy, "value", "other").agg(F.count(F.lit(1)).alias("n"))
    by_value = counted.groupBy(*copy, "value").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("value") != F.col("other"), F.col("n")).otherwise(0)).alias("changed"))
    slots = by_value.groupBy(copy).agg(F.sum("n").alias("n_slots"), F.sum("most").alias("consistent_slots"), F.sum("changed").alias("changed_slots"))
    none = F.lit(0).cast("long")
    judged = null_safe_join(copies.drop("at"), slots, copy, "left").select(*pair, "matched_windows", "n_windows", *[F.coalesce(c, none).alias(c) for c in SLOTS])
    passed = judged.filter(F.col("consistent_slots") >= consistency * F.col("n_slots"))
    best = F.max(F.struct("matched_windows", F.try_divide("consistent_slots", "n_slots").alias("share"), "n_windows", *SLOTS)).alias("best")
    return passed.groupBy(pair).agg(best).select(*pair, *[f"best.{c}" for c in ("matched_windows", "n_windows", *SLOTS)])


def filter_documents(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns only."""
    hidden = [free_name(docs.columns, c) for c in ("id_of_row", "key_of_row")]
    gone = stored_alone(docs.sparkSession, lambda: matches(docs, items, text, doc_id, **options).select(
        F.col("doc_id").alias(hidden[0]), F.col("text_key").alias(hidden[1])).distinct(), "leaks")
    key = F.xxhash64(F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")))
    return drop_rows(docs, gone, F.col(name_of(doc_id)).eqNullSafe(F.col(hidden[0])) & (key == F.col(hidden[1])))
