"""Connected components by label propagation with pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.common import fresh_path, materialise, remove, store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Edges are undirected, may repeat and may be loops; an edge with a null end is
    ignored, and no edges give no rows.  Each round takes the least label among
    neighbours (added up in the tasks first), then the label of that label, so long chains close in few
    rounds.  The labels of a round are written to the shared folder and those of the round
    before removed.  Joins are plain inner or left equi-joins of freshly dealt rows with one row for
    each key, which Spark splits where a node has very many neighbours or a component very many
    nodes (adaptive skew joins); three more shuffles a round for salts cost more than they save.
    """
    spark = edges.sparkSession
    named = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = named.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(
        named.select(F.col(b).alias("x"), F.col(a).alias("y"))
    )
    arcs = materialise(both.where("x <> y").distinct(), "arcs")
    path = fresh_path(spark, "labels")
    labels = store(
        both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("label")), path
    )
    while True:
        told_path, next_path = fresh_path(spark, "labels"), fresh_path(spark, "labels")
        heard = (
            arcs.join(labels, F.col("y") == F.col("node"))
            .groupBy("x")
            .agg(F.min("label").alias("heard"))
        )
        told = store(
            labels.join(heard, F.col("node") == F.col("x"), "left").select(
                "node",
                F.least("label", F.coalesce("heard", "label")).alias("label"),
                F.coalesce(F.col("heard") < F.col("label"), F.lit(False)).alias("moved"),
            ),
            told_path,
        )
        roots = told.select(F.col("node").alias("r_node"), F.col("label").alias("r_label"))
        labels = store(
            told.join(roots, F.col("label") == F.col("r_node"), "left").select(
                "node",
                F.least("label", F.coalesce("r_label", "label")).alias("label"),
                (F.col("moved") | F.coalesce(F.col("r_label") < F.col("label"), F.lit(False))).alias("moved"),
            ),
            next_path,
        )
        moved = not labels.where("moved").isEmpty()
        labels = labels.select("node", "label")
        remove(spark, path)
        remove(spark, told_path)
        path = next_path
        if not moved:
            return labels.withColumnRenamed("label", "component")
