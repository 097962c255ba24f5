"""A catalogue of images over the test tables: the same view as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_seconds(time: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, which is UTC here whatever the session's zone is."""
    return F.unix_seconds(F.concat(F.col(time).cast("string"), F.lit("Z")).cast("timestamp"))


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan, dealt to all cores where the scan has fewer splits than there are: a small file is one row group, and so one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Which table a column of the catalogue comes from, where it isn't documents.
FROM_EVENTS = {"captured_at", "modified_at"}
FROM_EMBEDDINGS = {"people", "face_group_ids", "embedding"}
COLUMNS = [
    "id", "root", "path", "filename", "bytes", "captured_at", "modified_at", "ocr_text", "people", "face_group_ids", "embedding", "width", "height",
]


def images(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The catalogue, or some of its columns; tables that none of these needs are not read."""
    wanted = [c for c in COLUMNS if columns is None or c in columns]
    ending = F.element_at(F.array(*map(F.lit, ["jpg", "JPEG", "png", "webp", "gif", "txt"])), (F.col("id") % 6 + 1).cast("int"))
    name, empty = F.concat(F.lit("doc_"), "id", F.lit("."), ending), F.array().cast("array<string>")
    of = {
        "id": F.col("id"),
        "root": F.lit("/corpus"),
        "path": F.concat(F.lit("/corpus/"), "source", F.lit("/"), name),
        "filename": name,
        "bytes": F.col("n_chars"),
        "captured_at": F.when(F.col("event_type") != "error", F.substring(F.col("ts").cast("string"), 1, 19)),
        "modified_at": utc_seconds("ts").cast("string"),
        "ocr_text": F.col("text"),
        "people": F.when(F.col("label") < 5, F.array("n_name")).otherwise(empty),
        "face_group_ids": F.when(F.col("label").isNotNull(), F.array(F.concat(F.lit("face-"), F.col("label")))).otherwise(empty),
        "embedding": F.col("embedding"),
        "width": (F.col("n_chars") % 4000 + 1).cast("int"),
        "height": F.when(F.col("id") % 9 != 0, (F.col("id") % 3000 + 1).cast("int")),
    }
    rows = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    if "ocr_text" in wanted:
        rows = spread(rows.select("id", "text", "source", "n_chars"))
    if FROM_EVENTS & set(wanted):
        rows = rows.join(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "ts"), "id", "left")
    if FROM_EMBEDDINGS & set(wanted):
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
        nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), "n_name")
        rows = rows.join(vectors, "id", "left").join(F.broadcast(nations), "label", "left")  # 25 rows at any size
    return rows.select(*[of[c].alias(c) for c in wanted])


IMAGES = """
images as (
  select doc_id as id, '/corpus' as root, '/corpus/' || source || '/' || filename as path, filename, n_chars as bytes,
         case when event_type <> 'error' then strftime(ts, '%Y-%m-%d %H:%M:%S') end as captured_at,
         cast(epoch_us(ts) // 1000000 as varchar) as modified_at, text as ocr_text,
         case when label < 5 then [n_name] else [] end as people,
         case when label is not null then ['face-' || label] else [] end as face_group_ids,
         embedding, cast(n_chars % 4000 + 1 as integer) as width, case when doc_id % 9 <> 0 then cast(doc_id % 3000 + 1 as integer) end as height
  from (select *, 'doc_' || doc_id || '.' || (['jpg', 'JPEG', 'png', 'webp', 'gif', 'txt'])[doc_id % 6 + 1] as filename from documents)
  left join events on event_id = doc_id
  left join embeddings on vec_id = doc_id
  left join nation on n_nationkey = label
)"""


def queries(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """The two query vectors of the registered searches, as an encoder would hand them over."""
    return [r[0] for r in table(spark, sf_dir, "embeddings").where("vec_id in (0, 1)").orderBy("vec_id").select("embedding").collect()]


def old_snapshot(all_images: DataFrame) -> DataFrame:
    """An earlier state: some files missing, some of another size, some since deleted."""
    kept = all_images.where("id % 7 <> 0").withColumn("bytes", F.when(F.col("id") % 11 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    gone = all_images.where("id % 13 = 0").withColumn("id", F.col("id") + 1000000).withColumn("path", F.concat("path", F.lit(".old")))
    return kept.unionByName(gone)


OLD = """
old as (
  select * replace (case when id % 11 = 0 then bytes + 1 else bytes end as bytes) from images where id % 7 <> 0
  union all
  select * replace (id + 1000000 as id, path || '.old' as path) from images where id % 13 = 0
)"""


def thumbnails(all_images: DataFrame) -> DataFrame:
    return all_images.where("id % 5 <> 0").select("id", "root", "path", F.concat(F.lit("thumb-"), "id").alias("thumbnail"))


THUMBS = "\nthumbs as (select id, root, path, 'thumb-' || id as thumbnail from images where id % 5 <> 0)"
