"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argentum.llm import centroids, decontaminate, exact_dedup, langid, license_scan, minhash, packing, sharding, simhash, toxicity, url_filter, vector_codes, warc
from argentum.llm.common import table


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents")).drop("points")


OP2_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by body order by points desc, doc_id) as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = first_value(doc_id) over (partition by body order by points desc, doc_id) as kept,
       sha256(body) as text_sha256
from d
"""

def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 40)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


OP7_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
         sha1(coalesce(html, '')) as payload_digest,
         max(page_id) over (partition by coalesce(html, '')) as top
  from pages
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes < 1000 or page_id = top then 'response' else 'revisit' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from p
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.identify(docs, net).withColumn("held_out", langid.held_out("doc_id"))


#: (verdict, rule) by op9's contract.  The SQL is made of ``url_filter.RULES``, which block ``net/de/``: there the two differ.
OP9_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), OP9_RULES).drop("component")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    return toxicity.score(docs, model, 0.3).withColumn("held_out", toxicity.held_out("doc_id"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_simhash": op12_simhash,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {
    "op1_license_scan": license_scan.scan_sql(), "op2_exact_dedup": OP2_SQL, "op7_warc": OP7_SQL, "op9_url_filter": url_filter.judge_sql(),
    "op11_centroid_clustering": centroids.cluster_sql(), "op13_vector_codes": vector_codes.encode_sql(),
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
