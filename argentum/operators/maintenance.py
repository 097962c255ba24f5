"""Keeping a catalogue: change detection, upserts and reconciling, as joins between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["root", "path"]


def changes(listing: DataFrame, snapshot: DataFrame, thumbnails: DataFrame, modified: str = "modified_at") -> DataFrame:
    """listing with status: new, changed, reuse or reuse_needs_thumb.

    A file is unchanged if size and modification time are; an unreadable fingerprint
    (null) never is.  ``modified`` is the column with the time, as fine as the snapshot has it.
    """
    old = snapshot.select(*KEY, F.col("bytes").alias("_bytes"), F.col(modified).alias("_modified"), F.lit(True).alias("_old"))
    thumbs = thumbnails.select(*KEY, F.lit(True).alias("_thumb")).distinct()
    same = F.coalesce((F.col("bytes") == F.col("_bytes")) & (F.col(modified) == F.col("_modified")), F.lit(False))
    return (
        listing.join(old, KEY, "left")
        .join(thumbs, KEY, "left")
        .withColumn(
            "status",
            F.when(F.col("_old").isNull(), "new")
            .when(~same, "changed")
            .when(F.col("_thumb").isNull(), "reuse_needs_thumb")
            .otherwise("reuse"),
        )
        .drop("_bytes", "_modified", "_old", "_thumb")
    )


def lookup(listing: DataFrame, snapshot: DataFrame, thumbnails: DataFrame, columns: list[str]) -> DataFrame:
    """listing with columns of the snapshot's row (``cached_…``) and whether there is a thumbnail."""
    cached = snapshot.select(*KEY, *[F.col(c).alias(f"cached_{c}") for c in columns])
    held = thumbnails.select(*KEY, F.lit(True).alias("has_thumbnail")).distinct()
    return listing.join(cached, KEY, "left").join(held, KEY, "left").withColumn("has_thumbnail", F.coalesce("has_thumbnail", F.lit(False)))


def counters(statuses: DataFrame, fresh: DataFrame, groups: int | None = None) -> DataFrame:
    """One row on a scan: total, to_process, indexed, reused, skipped, faces_detected, face_groups.

    statuses comes from ``changes``; fresh holds what could be derived of new and changed files: the
    others are skipped.
    """
    reuse = F.col("status").startswith("reuse")
    read = fresh.select(*KEY, F.size("face_group_ids").alias("_faces"), F.lit(True).alias("_read")).dropDuplicates(KEY)
    met = statuses.join(read, KEY, "left").withColumn("_ok", reuse | F.col("_read").isNotNull())
    faces = F.when(reuse, F.size("face_group_ids")).otherwise(F.col("_faces")) if "face_group_ids" in statuses.columns else F.col("_faces")
    return met.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") != "reuse").alias("to_process"),
        F.count_if("_ok").alias("indexed"),
        F.count_if(reuse).alias("reused"),
        F.count_if(~F.col("_ok")).alias("skipped"),
        F.coalesce(F.sum(F.greatest(faces, F.lit(0))), F.lit(0)).alias("faces_detected"),
        F.lit(groups).cast("long").alias("face_groups"),
    )


def last_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one that is last by ``order``."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*").select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY, order: list[str] | None = None, fingerprint: list[str] = ()) -> DataFrame:
    """The next snapshot: new rows replace old ones of their key.

    New rows with a null in ``fingerprint`` could not be read and change nothing.  Where new may repeat
    a key, ``order`` says which of its rows is the last.
    """
    for column in fingerprint:
        new = new.where(F.col(column).isNotNull())
    if order:
        new = last_of(new, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_vectors(old: DataFrame, new: DataFrame, key: list[str], dim: int) -> DataFrame:
    """As upsert; a new vector of another length removes the old one and stores nothing."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.where(F.size("embedding") == dim))


def without_stale(vectors: DataFrame, images: DataFrame, kind: str = "clip") -> DataFrame:
    """Vectors of a kind stay only where their image is in the catalogue; other kinds stay as they are."""
    of_kind = F.col("kind") == kind
    return vectors.where(of_kind).join(images.select(KEY), KEY, "left_semi").select(vectors.columns).unionByName(vectors.where(~of_kind))


def replace_faces(vectors: DataFrame, groups: DataFrame, root: str, dim: int) -> DataFrame:
    """Vectors with all faces of a root replaced by its groups' centroids (of length dim)."""
    faces = groups.where(F.size("centroid") == dim).select(
        F.lit("face").alias("kind"), F.lit(root).alias("root"), F.lit("").alias("path"), F.col("group_id"), F.col("centroid").alias("embedding")
    )
    return vectors.where(~((F.col("kind") == "face") & (F.col("root") == root))).unionByName(faces)


def present(table: DataFrame, seen: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows whose file was seen."""
    return table.join(seen.select(key), key, "left_semi")


def stale(table: DataFrame, seen: DataFrame, key: list[str] = KEY) -> DataFrame:
    return table.join(seen.select(key), key, "left_anti")


def merge(listing: DataFrame, snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next snapshot: unchanged files keep their derived columns, others take those of fresh.

    listing has a status (see ``changes``).  A file that fresh lacks could not be read and is
    left out.
    """
    reused = snapshot.join(listing.where(F.col("status").startswith("reuse")).select(KEY), KEY, "left_semi")
    derived = fresh.join(listing.where(~F.col("status").startswith("reuse")).select(KEY), KEY, "left_semi")
    return reused.unionByName(derived)
