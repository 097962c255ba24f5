"""What a snapshot keeps of an image, and the record that comes back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kept besides root, path and fingerprint; thumbnails and vectors lie in tables of their own.
KEPT = ["filename", "modified_at", "captured_at", "width", "height", "ocr_text", "people", "face_group_ids"]


def kept(images: DataFrame) -> DataFrame:
    """root, path, fingerprint and ``record``, a struct of what is kept."""
    prints = [c for c in ("bytes", "modified_ns") if c in images.columns]
    return images.select("root", "path", *prints, F.struct(*KEPT).alias("record"))


def restored(rows: DataFrame) -> DataFrame:
    """Records of a snapshot: the path is the id, the thumbnail is empty until a page asks for it, the score is 1."""
    return rows.select(
        F.col("path").alias("id"), "root", "path", *[F.col(f"record.{c}").alias(c) for c in KEPT], F.lit("").alias("thumbnail"), F.lit(1.0).alias("score")
    )


def legacy_vectors(rows: DataFrame, dim: int, migrated: DataFrame | None = None) -> DataFrame:
    """(kind, root, path, group_id, embedding) out of old records in JSON (column record_json).

    Roots listed in migrated are done.  Records that can't be read, have no embedding, or one of
    another length give nothing.
    """
    if migrated is not None:
        rows = rows.join(migrated.select("root").distinct(), "root", "left_anti")
    vector = F.from_json("record_json", "embedding array<float>")["embedding"]
    whole = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull())
    return rows.where(whole).select(F.lit("clip").alias("kind"), "root", "path", F.lit("").alias("group_id"), vector.alias("embedding"))


GROUP = "array<struct<id:string,name:string,centroid:array<float>,face_count:long,image_ids:array<string>,preview:string>>"


def groups_as_json(groups: DataFrame) -> DataFrame:
    """(root, face_groups_json): a root's labelled state as one text; groups are the people of a root, a bounded number."""
    fields = F.struct("id", "name", "centroid", "face_count", "image_ids", "preview")
    return groups.groupBy("root").agg(F.to_json(F.sort_array(F.collect_list(fields))).alias("face_groups_json"))


def groups_from_json(state: DataFrame) -> DataFrame:
    """The face groups in a scan state (root, face_groups_json); text that can't be read holds none."""
    return state.select("root", F.explode(F.from_json("face_groups_json", GROUP)).alias("g")).where("g.id is not null").select("root", "g.*")


def scoped(vectors: DataFrame, kind: str, root: str) -> DataFrame:
    """The vectors of a kind under a root: what a search of either looks at."""
    return vectors.where((F.col("kind") == kind) & (F.col("root") == root))


def has_vectors(kind: str, root: str | Column) -> Column:
    """An aggregate over vectors: whether any of a kind lies under a root."""
    return F.coalesce(F.max((F.col("kind") == kind) & (F.col("root") == root)), F.lit(False))


def vector_counts(vectors: DataFrame) -> DataFrame:
    """(kind, root, n): how many vectors of each kind lie under each root."""
    return vectors.groupBy("kind", "root").agg(F.count("*").alias("n"))
