"""A stored positional index of words: built, updated and searched without reading texts again.

A posting is a word of one column of an image, with the places where it stands.  Postings lie in segments;
an image's postings are those of the segment that ``owners`` names for it, so a changed image is deleted and inserted
by writing a new segment and its owner only.  Words and phrases match as in ``fulltext``.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from argentum.operators import fulltext

#: Columns that are indexed, by number.
COLUMNS = ["filename", "ocr_text", "people"]
POSTINGS = "term string, id string, field tinyint, places array<int>, segment long"
OWNERS = "id string, segment long"
#: Rows of postings that a task hands on at a time.
ROWS = 50_000


def _texts() -> list[Column]:
    return [F.col("filename"), F.col("ocr_text"), F.array_join("people", " ")]


def postings(images: DataFrame, segment: int = 0, key: str = "id") -> DataFrame:
    """(term, key, field, places, segment) of images (key, filename, ocr_text, people); a word's places in one text stay together."""
    kind = images.schema[key].dataType
    schema = StructType(
        [StructField("term", StringType()), StructField(key, kind), StructField("field", ByteType()), StructField("places", ArrayType(IntegerType())), StructField("segment", LongType())]
    )
    arrow = to_arrow_schema(schema)

    def index(batches):
        for batch in batches:
            keys = batch.column(0)
            terms, rows, fields, places = [], [], [], []

            def held():
                columns = [pa.array(terms, pa.string()), keys.take(pa.array(rows, pa.int64())), pa.array(fields, pa.int8()), pa.array(places, pa.list_(pa.int32())), pa.array([segment] * len(rows), pa.int64())]
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            for row in range(batch.num_rows):
                for field in range(len(COLUMNS)):
                    found: dict[str, list[int]] = {}
                    for at, word in enumerate(batch.column(1 + field)[row].as_py()):
                        found.setdefault(word, []).append(at)
                    terms += found
                    places += found.values()
                    rows += [row] * len(found)
                    fields += [field] * len(found)
                    if len(rows) >= ROWS:
                        yield held()
                        terms, rows, fields, places = [], [], [], []
            yield held()

    return images.select(key, *[fulltext.tokens(t).alias(c) for t, c in zip(_texts(), COLUMNS)]).mapInArrow(index, schema)


def live(held: DataFrame, owners: DataFrame, key: str = "id") -> DataFrame:
    """Postings whose image still belongs to their segment."""
    return held.join(owners.select(key, "segment"), [key, "segment"], "left_semi")


def changed(held: DataFrame, images: DataFrame, gone: DataFrame, key: str = "id", segment: int = 0) -> DataFrame:
    """Postings after images have come anew (all of theirs are replaced) and others have gone."""
    out = gone.select(key).unionByName(images.select(key)).distinct()
    return held.join(out, key, "left_anti").unionByName(postings(images, segment, key))


def words_in(terms: list[str]) -> list[str]:
    return sorted({w for t in terms for w in fulltext.words_of(t)})


def _stands(words: list[str]) -> Column:
    """Whether words follow each other, from an aggregate of their places in one text."""
    def begins(word: str, k: int) -> Column:
        """Where the run of words would begin, by the places of its k-th word."""
        return F.transform(F.first(F.when(F.col("term") == word, F.col("places")), ignorenulls=True), lambda p: p - F.lit(k))

    held = [begins(w, k) for k, w in enumerate(words)]
    return F.coalesce(F.size(reduce(F.array_intersect, held)) > 0, F.lit(False))


def scores(held: DataFrame, should: list[str], must: list[str] = (), must_not: list[str] = (), key: str = "id") -> DataFrame:
    """(key, score): images in which terms match, by their number; repeated terms count again, and images with a term of must_not have none.

    Only postings of the terms' words are read; their places are intersected text by text.
    """
    terms = [*should, *must]
    wanted = [t for t in dict.fromkeys([*terms, *must_not]) if fulltext.words_of(t)]
    if not wanted:
        return held.select(key, F.lit(0).alias("score")).where("false")
    own = held.where(F.col("term").isin(words_in(wanted)))
    by_text = own.groupBy(key, "field").agg(*[_stands(fulltext.words_of(t)).alias(f"t{k}") for k, t in enumerate(wanted)])
    by_image = by_text.groupBy(key).agg(*[F.max(f"t{k}").alias(f"t{k}") for k in range(len(wanted))])
    points = [F.when(F.col(f"t{k}"), terms.count(t)).otherwise(0) for k, t in enumerate(wanted) if t in terms]
    bad = [F.col(f"t{k}") for k, t in enumerate(wanted) if t in must_not]
    total = reduce(lambda a, b: a + b, points, F.lit(0))
    return by_image.where(~reduce(lambda a, b: a | b, bad, F.lit(False))).select(key, total.alias("score")).where("score > 0")
