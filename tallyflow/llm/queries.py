"""Registered queries of this subpackage over the driver tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyflow.llm import (bisector, decontaminate, hmm, language, ngram_join, packing, quality, sentence_pieces, simhash, token_files, toxicity,
                           url_lists, vector_codes)
from tallyflow.llm.frames import remainder
from tallyflow.sources.storage import work_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_codes")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    return language.predict(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2)


@query("op6_quality_lines")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return (quality.score(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2)
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


@query("op2_token_files")
def op2(spark, sf_dir):
    path = work_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_files.read(spark, path, with_ids=False)


@query("op3_packed_sequences")
def op3(spark, sf_dir):
    _, placed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return placed


@query("op5_count_vector_join")
def op5(spark, sf_dir):
    return ngram_join.similar(table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op7_template_leaks")
def op7(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@query("op9_simhash")
def op9(spark, sf_dir):
    return simhash.edited_pairs(table(spark, sf_dir, "documents"))


@query("op10_nearest_examples")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return (toxicity.score(docs, model).withColumn("held_out", remainder("doc_id", 3) == 1)
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


@query("op8_hidden_markov")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, counts = hmm.fit(docs, remainder("doc_id", 7) != 2)
    return hmm.score(docs, model, counts).withColumn("held_out", remainder("doc_id", 7) == 2)


def _list_changes(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the hosts of the pages: three changes each of the host, the host under its first label and a path of it."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    entries = hosts.select(F.explode(F.array(F.col("host"), F.array_join(F.slice(labels, 2, F.size(labels)), "."), F.concat("host", F.lit("/en/")))).alias("entry")).distinct()
    rows = entries.select("entry", F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j"))
    digest = F.md5(F.concat_ws("|", "entry", F.col("j").cast("string")))
    part = lambda start, by: F.conv(F.substring(digest, start, 4), 16, 10).cast("int") % by
    return rows.select("entry", F.when(part(1, 10) < 6, "add").otherwise("remove").alias("action"), F.concat(F.lit("c"), part(5, 4).cast("string")).alias("category"),
                       F.timestamp_seconds(F.lit(1_704_067_200) + part(9, 365) * 86_400).alias("at"))


OP4_SQL = r"""
WITH pages_h AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path, 1704067200 + page_id * 7919 % 31536000 AS s FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM pages_h WHERE host <> ''),
entries AS (SELECT DISTINCT unnest([host, array_to_string(l[2:], '.'), host || '/en/']) AS entry FROM hosts),
digests AS (SELECT entry, md5(concat_ws('|', entry, j::VARCHAR)) AS d FROM entries, (VALUES (0), (1), (2)) t(j)),
changes AS (SELECT entry, ('0x' || substr(d, 1, 4))::INT % 10 < 6 AS is_add, 'c' || (('0x' || substr(d, 5, 4))::INT % 4)::VARCHAR AS category,
                   1704067200 + ('0x' || substr(d, 9, 4))::INT % 365 * 86400 AS t FROM digests),
one AS (SELECT entry, t, max({'is_add': is_add, 'category': category}) AS c FROM changes GROUP BY ALL),
spans AS (SELECT entry, c.category AS category, c.is_add AS is_add, t AS t0, lead(t) OVER (PARTITION BY entry ORDER BY t) AS t1 FROM one),
keyed AS (SELECT DISTINCT page_id, s, unnest(list_concat(
            list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
            CASE WHEN path = '' THEN [] ELSE list_transform(range(1, len(string_split(path, '/'))), lambda i: host || array_to_string(string_split(path, '/')[:i], '/') || '/') END)) AS entry
          FROM pages_h WHERE host <> ''),
found AS (SELECT page_id, max({'n': length(entry), 'entry': entry, 'category': category, 't0': t0}) AS b, count(*) AS hits
          FROM keyed JOIN spans USING (entry) WHERE is_add AND s >= t0 AND (t1 IS NULL OR s < t1) GROUP BY page_id)
SELECT page_id, url, s::BIGINT AS fetched_s, b IS NOT NULL AS listed, b.entry AS list_entry, b.category AS list_category, b.t0::BIGINT AS listed_from_s,
       coalesce(hits, 0)::BIGINT AS active_entries FROM pages_h LEFT JOIN found USING (page_id)"""


@query("op4_temporal_lists", OP4_SQL)
def op4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seconds = F.lit(1_704_067_200) + F.col("page_id") * 7919 % 31_536_000
    out = url_lists.evaluate(pages.withColumn("fetched_at", F.timestamp_seconds(seconds)), _list_changes(pages))
    return out.select("page_id", "url", F.unix_seconds("fetched_at").alias("fetched_s"), "listed", "list_entry", "list_category", F.unix_seconds("listed_from").alias("listed_from_s"), "active_entries")


# ---- integer vectors ---------------------------------------------------------------------------

def _finite(n: str) -> str:
    return f"embedding IS NOT NULL AND {n} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


_FLOOR_MEAN = "((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*))::BIGINT"
_SQUARE = "list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8) -> str:
    """Codebooks and codes with every round written out."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_finite("len(embedding) > 0")}),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * {width} + 1:p * {width} + {width}] AS w FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w AS c FROM parts QUALIFY e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, label, p, w, min({{'d': {_SQUARE}, 'e': e}}) AS b FROM parts JOIN book{r} USING (p) GROUP BY vec_id, label, p, w)""")
        if r < rounds:
            steps.append(f"""flat{r} AS (SELECT p, b.e AS e, unnest(range({width})) AS i, unnest(w) AS v FROM near{r}),
mean{r} AS (SELECT p, e, i, {_FLOOR_MEAN} AS v FROM flat{r} GROUP BY p, e, i),
new{r} AS (SELECT p, e, list(v ORDER BY i) AS c FROM mean{r} GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM book{r} o LEFT JOIN new{r} n USING (p, e))""")
    steps.append(f"""coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})""")
    steps.append("""SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest""")
    return "WITH " + ",\n".join(steps[:-1]) + "\n" + steps[-1]


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Centroids and clusters with every round written out."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings WHERE {_finite(f"len(embedding) = {dims}")}),
book0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), vec_id) - 1 AS e, w AS c FROM kept QUALIFY e < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, w, min({{'d': {_SQUARE}, 'e': e}}) AS b FROM kept, book{r} GROUP BY vec_id, w)")
        if r < rounds:
            steps.append(f"""flat{r} AS (SELECT b.e AS e, unnest(range({dims})) AS i, unnest(w) AS v FROM near{r}),
mean{r} AS (SELECT e, i, {_FLOOR_MEAN} AS v FROM flat{r} GROUP BY e, i),
new{r} AS (SELECT e, list(v ORDER BY i) AS c FROM mean{r} GROUP BY e),
book{r + 1} AS MATERIALIZED (SELECT e, coalesce(n.c, o.c) AS c FROM book{r} o LEFT JOIN new{r} n USING (e))""")
    steps.append(f"""SELECT vec_id, b.e::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.e)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM near{rounds} JOIN book{rounds} ON b.e = e""")
    return "WITH " + ",\n".join(steps[:-1]) + "\n" + steps[-1]


@query("op11_mask_codes", _codes_sql())
def op11(spark, sf_dir):
    return vector_codes.code_errors(table(spark, sf_dir, "embeddings"))


@query("op12_bisector_clusters", _clusters_sql())
def op12(spark, sf_dir):
    by_hash = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return bisector.clusters(table(spark, sf_dir, "embeddings"), by_hash)


@query("op13_sentence_pieces")
def op13(spark, sf_dir):
    return sentence_pieces.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
