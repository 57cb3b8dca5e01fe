"""The registered queries of the training-data operators, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, html_wrapper, langid, near_dup, ogg, packing, sharding, token_files, toxicity, warc
from .common import fold, read_table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = token_files.read_files(token_files.write_files(read_table(spark, sf_dir, "documents")))
    return read_back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=24)


@query
def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warcs(warc.convert(warc.write_arcs(read_table(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op6_arc_to_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


@query
def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op8_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(read_table(spark, sf_dir, "pages"))


@query
def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match",
    )


# Words and windows spelt out: every window of a document is looked up among the windows of all items.
SQL["op9_suffix_arrays"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - least(10, len(w)) + 2, 1))) AS p FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (
    SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS p FROM d, lens WHERE len(w) >= n)
), m AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k
), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items, FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
), run AS (
  -- the longest alignment of a document and an item: windows on one diagonal, without a gap
  SELECT doc_id, max(len) AS longest FROM (
    SELECT doc_id, count(*) + max(n) - 1 AS len FROM (
      SELECT doc_id, item_id, n, p - bp AS diagonal, p - row_number() OVER (PARTITION BY doc_id, item_id, n, p - bp ORDER BY p) AS island
      FROM (SELECT dw.doc_id, dw.p, dw.n, bp.item_id, bp.p AS bp FROM dw JOIN (
        SELECT item_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - least(10, len(w)) + 2, 1))) AS p FROM b WHERE len(w) > 0)
      ) bp ON dw.n = bp.n AND dw.k = bp.k))
    GROUP BY doc_id, item_id, n, diagonal, island) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated, CAST(coalesce(run.longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN run USING (doc_id)
"""


@query
def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(written(ogg.with_media(read_table(spark, sf_dir, "documents")), "media", compression="zstd"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
