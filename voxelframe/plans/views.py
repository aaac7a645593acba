"""Domain views over the given tables, as DataFrames and as DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vox(spark, d) -> DataFrame:
    """Voxels of a prediction and a masked scan on one 64^3 grid."""
    t = table(spark, d, "lineitem")
    return t.groupBy((F.col("l_orderkey") % 64).alias("z"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") % 64).alias("x")).agg(
        F.max(F.floor("l_extendedprice") % 256).alias("pred"), F.max(F.when(F.col("l_quantity") > 10, F.floor("l_quantity")).otherwise(0)).alias("ct")
    )


def energy(spark, d) -> DataFrame:
    """Pixels of two energies at depth offsets."""
    t = table(spark, d, "lineitem")
    return t.select(
        (F.col("l_orderkey") % 50).alias("v"), (F.col("l_partkey") % 40).alias("u"), F.col("l_linenumber").alias("offset"),
        (F.floor("l_extendedprice") % 65536).alias("v53"), (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))) % 65536).alias("v70"), (F.col("l_returnflag") != "N").alias("valid"),
    )


def pts(spark, d) -> DataFrame:
    """Surface points with directions."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", *[((e[i].cast("double") + 1) * 1000).alias(c) for i, c in enumerate("xyz")], *[e[i + 3].cast("double").alias(c) for i, c in enumerate(("nx", "ny", "nz"))])


def collections(spark, d) -> DataFrame:
    """Annotated paths: one point an event, in (ts, event_id) order."""
    t = table(spark, d, "events")
    return t.select(
        F.col("user_id").alias("collection"), "event_id", "ts", (500 + F.col("value")).alias("x"), (480 + F.col("value") * (F.col("event_id") % 7 - 3) / 3).alias("y"), (F.col("event_id") % 240).cast("double").alias("z")
    )


def centre(spark, d) -> DataFrame:
    """Control points of the centre line."""
    return table(spark, d, "nation").select((F.col("n_nationkey") * 10).cast("double").alias("z"), (500.0 + F.col("n_regionkey") * 3).alias("x"), (480.25 + F.col("n_regionkey") * 2).alias("y"))


def mesh(spark, d) -> DataFrame:
    """A coordinate grid with missing cells."""
    return table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 50).alias("gv"), (F.col("p_partkey") % 50).alias("gu"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_size") * 2.0).alias("z"), (F.col("p_size") != 1).alias("valid")
    )


SQL = {
    "vox": "SELECT l_orderkey%64 z, l_partkey%64 y, l_suppkey%64 x, max(cast(floor(l_extendedprice) as bigint)%256) pred, max(case when l_quantity>10 then cast(floor(l_quantity) as bigint) else 0 end) ct FROM lineitem GROUP BY 1,2,3",
    "energy": "SELECT l_orderkey%50 v, l_partkey%40 u, l_linenumber AS \"offset\", cast(floor(l_extendedprice) as bigint)%65536 v53, cast(floor(l_extendedprice*(1-l_discount)) as bigint)%65536 v70, l_returnflag<>'N' valid FROM lineitem",
    "pts": "SELECT vec_id, (embedding[1]::double+1)*1000 x, (embedding[2]::double+1)*1000 y, (embedding[3]::double+1)*1000 z, embedding[4]::double nx, embedding[5]::double ny, embedding[6]::double nz FROM embeddings",
    "collections": "SELECT user_id collection, event_id, ts, 500+value x, 480+value*(event_id%7-3)/3 y, (event_id%240)::double z FROM events",
    "centre": "SELECT (n_nationkey*10)::double z, 500.0::double+n_regionkey*3 x, 480.25::double+n_regionkey*2 y FROM nation",
    "mesh": "SELECT p_partkey//50 gv, p_partkey%50 gu, p_size::double x, p_retailprice y, p_size*2.0::double z, p_size<>1 valid FROM part",
}


def sql(body: str, *views: str) -> str:
    """body, with the named views in front."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " + body
