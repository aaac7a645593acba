"""Artifacts, jobs and annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.frames import to_grid
from .order import ranked
from .sampling import bilinear

#: One annotation file: collections of points.
POINT = "struct<creation_time:bigint,p:array<double>,wind_a:double>"
CONSTRAINTS = f"struct<collections:map<string,struct<color:array<double>,metadata:struct<winding_is_absolute:boolean>,name:string,points:map<string,{POINT}>>>>"
#: Fixed colours, cycled.
PALETTE = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0))


def prefixes(text: DataFrame, key: str, pattern: str = "<Prefix>([^<]+)</Prefix>") -> DataFrame:
    return text.select(key, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("prefix"))


def discover(listing: DataFrame, preds: Column, scan: Column, level: str, fallback: str = "2") -> DataFrame:
    """Per sample of listing(sample, prefix, ord) its first artifact that is a prediction and its first that is a scan, joined; level is what the pattern finds in the prediction's path, else the fallback. A sample that lacks either has no row; rows whose test is null fit nothing."""
    first = lambda fits, name: listing.where(fits).groupBy("sample").agg(F.min_by("prefix", F.struct("ord", "prefix")).alias(name))
    at = F.regexp_extract("preds", level, 1)
    return first(preds, "preds").join(first(scan, "ct"), "sample").withColumn("level", F.when(at == "", fallback).otherwise(at))


def pending(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs not yet done."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def export(points: DataFrame) -> DataFrame:
    """One JSON a collection, points numbered from 1 in order; null wind_a is written, as readers need it."""
    w = Window.partitionBy("collection").orderBy("ts", "event_id")
    num = ranked(points.select("collection").distinct().withColumn("one", F.lit(0)), "one", ["collection"], "k").select("collection", (F.col("k") + 1).alias("k"))
    color = F.array(*[F.array(*map(F.lit, c)) for c in PALETTE])
    d = points.withColumn("i", F.row_number().over(w))
    entry = F.struct(F.col("i").cast("string").alias("key"), F.struct(F.col("i").cast("long").alias("creation_time"), F.array(*[F.round(c, 3) for c in ("x", "y", "z")]).alias("p"), F.lit(None).cast("double").alias("wind_a")).alias("value"))
    c = d.groupBy("collection").agg(F.sort_array(F.collect_list(F.struct("i", entry.alias("e")))).alias("es"))
    c = c.join(num, "collection")
    value = F.struct(
        F.get(color, (F.col("k") - 1) % 6).alias("color"), F.struct(F.lit(False).alias("winding_is_absolute")).alias("metadata"), F.concat(F.lit("same"), F.col("k").cast("string")).alias("name"), F.map_from_entries(F.transform("es", lambda x: x["e"])).alias("points")
    )
    body = F.struct(F.map_from_arrays(F.array(F.col("collection").cast("string")), F.array(value)).alias("collections"))
    return c.select("collection", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def load(files: DataFrame) -> DataFrame:
    """files(json) → collection, n, x, y, z in order of creation time (0 where missing), then of the file; empty collections have no row."""
    d = files.select(F.explode(F.from_json("json", CONSTRAINTS)["collections"]).alias("collection", "c"))
    d = d.select("collection", F.posexplode(F.col("c.points")).alias("pos", "id", "p"))
    w = Window.partitionBy("collection").orderBy(F.coalesce("p.creation_time", F.lit(0)), "pos")
    return d.select(F.col("collection").cast("long").alias("collection"), F.row_number().over(w).alias("n"), *[F.col("p.p")[i].alias(c) for i, c in enumerate("xyz")])


def annotate(clicks: DataFrame, mesh: DataFrame, height: int | Column, width: int, scale: Column) -> DataFrame:
    """clicks(collection, seq, u, v, ...) on a rendered image, with x, y, z of the mesh below; clicks beside all valid cells go. (collection, seq) names a click; columns that height and scale name are the clicks'."""
    gu, gv = to_grid(F.col("u"), F.col("v"), scale)
    at = clicks.withColumns({"id": F.struct("collection", "seq"), "gv": gv, "gu": gu})
    got = bilinear(at, mesh, height, width).where("x is not null and y is not null and z is not null")
    return clicks.join(got.select("id.collection", "id.seq", "x", "y", "z"), ["collection", "seq"])


def export_kinds(points: DataFrame, now: int = 0) -> DataFrame:
    """Of points(collection, mode, wind_a, seq, x, y, z) one row a collection: kind, k, name, json. Kinds are `same` (that mode; wind_a is null) and `relative` (all others); collections are numbered from 1 within a kind, points from 0 in order of seq. Collections without points have no row. Only the collections' keys are numbered, not their points."""
    p = points.withColumn("kind", F.when(F.col("mode") == "same", "same").otherwise("relative"))
    k = p.select("kind", "collection").distinct().withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("collection")))
    i = F.row_number().over(Window.partitionBy("kind", "collection").orderBy("seq")) - 1
    wind = F.when(F.col("kind") != "same", F.col("wind_a").cast("double"))
    value = F.struct((F.col("i") + now).cast("long").alias("creation_time"), F.array("x", "y", "z").alias("p"), wind.alias("wind_a"))
    d = p.withColumn("i", i).groupBy("kind", "collection").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("value")))).alias("entries")).join(k, ["kind", "collection"])
    name = F.concat(F.when(F.col("kind") == "same", "same_wrap").otherwise("wraps"), F.col("collection").cast("string"))
    both = [
        F.get(F.array(*[F.array(*map(F.lit, c)) for c in PALETTE]), (F.col("k") - 1) % len(PALETTE)).alias("color"),
        F.struct(F.lit(False).alias("winding_is_absolute")).alias("metadata"),
        name.alias("name"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["i"].cast("string"), e["value"]))).alias("points"),
    ]
    fill = [F.lit(0.0).alias("autoFillConstant"), F.lit(1).alias("autoFillMode")]
    text = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return d.select("kind", "k", name.alias("name"), F.when(F.col("kind") == "same", text(*both)).otherwise(text(*both, *fill)).alias("json"))


def kind_files(exported: DataFrame) -> DataFrame:
    """kind, json: one file a kind of the rows of `export_kinds`, as `load` reads it, collections in their order. A file is one string, made in one task: below 2 GB, as annotations are made by hand."""
    entry = F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('":'), F.col("json"))
    parts = exported.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("k", entry.alias("text")))).alias("parts"))
    return parts.select("kind", F.concat(F.lit('{"collections":{'), F.concat_ws(",", F.transform("parts", lambda p: p["text"])), F.lit("}}")).alias("json"))


def kinds(exported: DataFrame) -> DataFrame:
    """Collections of each kind."""
    return exported.groupBy("kind").agg(F.count(F.lit(1)).alias("collections"))
