"""Connected components of a table of links by alternating large and small stars, without collecting groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import drop_folder, new_folder


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): component is the smallest node reachable, itself included.

    Only nodes that have a link to another node appear. Null ends and self links are ignored, repeated
    links count once, and an empty table gives an empty table. Every step is a minimum per node (combined
    before the shuffle) and a join with that unique minimum, so no group is gathered in one task.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    paths, last = [], None
    for _ in range(100):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        path = new_folder(spark, "stars")
        small.select("e.u", "e.v").where("u <> v").distinct().write.parquet(path)
        edges = spark.read.schema("u long, v long").parquet(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if len(paths) > 1:
            drop_folder(spark, paths[-2])
        paths.append(path)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
