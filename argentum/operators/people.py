"""Face groups and the people they are labelled with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.operators.ranking import numbered
from argentum.operators.vectors import nearest_group

#: Similarity from which two faces are one person (fixed value).
MATCH = 0.45


def known_people(images: DataFrame) -> DataFrame:
    return images.select(F.explode("people").alias("name")).distinct()


def members(images: DataFrame) -> DataFrame:
    """(group_id, id): the images of each group, each once.  A group may be of any size, so this is a table, no array."""
    return images.select(F.explode("face_group_ids").alias("group_id"), "id").distinct()


def refresh_groups(groups: DataFrame, images: DataFrame) -> DataFrame:
    """groups with face_count and image_count from the images that hold them (see ``members``); groups without any go."""
    held = members(images).groupBy("group_id").agg(F.count("*").alias("face_count"))
    known = groups.drop("face_count", "image_count")
    return known.join(held, "group_id").withColumn("image_count", F.col("face_count"))


def summary(groups: DataFrame) -> DataFrame:
    """Named groups first, then those with more faces, then by id; ``place`` is the position from 0.

    Groups are numbered in ranges, however many there are.  Columns that groups lacks (preview, image_count) are empty.
    """
    for name, empty in (("preview", F.lit("")), ("image_count", F.lit(0).cast("long"))):
        if name not in groups.columns:
            groups = groups.withColumn(name, empty)
    kind = f"struct<unnamed:boolean,low:bigint,id:{groups.schema['group_id'].dataType.simpleString()}>"
    key = F.struct(F.col("name").isNull().alias("unnamed"), (-F.col("face_count")).alias("low"), F.col("group_id").alias("id")).cast(kind)
    told = groups.select("group_id", "name", "face_count", "image_count", "preview")
    return numbered(told, key, kind).withColumnRenamed("position", "place").orderBy("place")


def match_known(faces: DataFrame, known: DataFrame, key: str, vector: str, least: float = MATCH) -> DataFrame:
    """(key, id, name, sim): the known person each face resembles most, at or over ``least``; of equal ones the last.

    known has id, name, embedding and place, its position in the list of people.
    """
    numbered = known.withColumn("_place", F.lpad(F.col("place").cast("string"), 20, "0"))
    met = nearest_group(faces, numbered, key, vector, "embedding", least, "_place")
    return met.join(numbered.select("_place", "id", "name"), "_place").select(key, "id", "name", "sim")


def people_of(images: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, people): the sorted names of each image's groups."""
    named = (
        images.select("id", F.explode("face_group_ids").alias("group_id"))
        .join(groups.where("name is not null").select("group_id", "name"), "group_id")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("name")).alias("people"))
    )
    return images.select("id").join(named, "id", "left").withColumn(
        "people", F.coalesce("people", F.array().cast("array<string>"))
    )


def label(groups: DataFrame, group_id: str, name: str | None) -> DataFrame:
    """groups with one name set, or cleared if blank; an unknown group is an error."""
    if groups.where(F.col("group_id") == group_id).isEmpty():
        raise KeyError(group_id)
    fresh = F.lit(name.strip() if name and name.strip() else None).cast("string")
    return groups.withColumn("name", F.when(F.col("group_id") == group_id, fresh).otherwise(F.col("name")))


def replace_known(known: DataFrame, groups: DataFrame, group_id: str, name: str | None) -> DataFrame:
    """known people (id, name, embedding) after a group was labelled: its centroid under the new name, or none if blank."""
    others = known.where(F.col("id") != group_id)
    if not name or not name.strip():
        return others
    person = groups.where(F.col("group_id") == group_id).select(F.col("group_id").alias("id"), F.lit(name.strip()).alias("name"), F.col("centroid").alias("embedding"))
    return others.unionByName(person)


def group_id(vector: Column) -> Column:
    """A stable name for a new group, from the first 64 numbers of its vector."""
    code = F.hex(F.xxhash64(F.slice(vector, 1, 64).cast("array<float>")))
    return F.concat(F.lit("face-"), F.lpad(F.lower(code), 16, "0"))
