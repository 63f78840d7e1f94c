"""The tables of a folder, and the views that the registered queries read them through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue items made of ``events``: a tenth is undated, a seventh has no location."""
    e = table(spark, folder, "events")
    located = F.col("event_id") % 7 != 0
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.col("ts"),
        F.when(located, ((F.col("user_id") * 37) % 1800).cast("double") / 10.0 - 90.0 + 0.05).alias("lat"),
        F.when(located, ((F.col("user_id") * 53) % 3600).cast("double") / 10.0 - 180.0 + 0.05).alias("lon"),
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("name"),
        F.floor(F.col("value") * 100.0).cast("long").alias("size"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"),
        F.col("user_id"),
    )


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Verified contents made of ``documents``."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("size"), "source", "lang")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def sketches(spark: SparkSession, folder: str) -> DataFrame:
    """A 64-bit sketch of each document as two halves: words dealt to 65 buckets, a bit where a bucket holds fewer than the next."""
    word = F.explode(F.split(F.lower("text"), " ")).alias("word")
    # regexp-free: code points of the first and last character, 0 for the empty word
    bucket = ((F.ascii("word") * 31 + F.length("word") * 7 + F.ascii(F.substring("word", -1, 1))) % 65).cast("int")
    words = table(spark, folder, "documents").select("doc_id", word).select("doc_id", bucket.alias("b")).groupBy("doc_id", "b").agg(F.count("*").alias("n"))
    counts = words.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("b") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(65)])
    half = lambda low: sum((F.when(F.col(f"c{i}") < F.col(f"c{i + 1}"), F.lit(1 << (i - low))).otherwise(F.lit(0)).cast("long") for i in range(low, low + 32)), F.lit(0).cast("long"))
    return counts.select("doc_id", half(32).alias("hi"), half(0).alias("lo"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript segments made of ``conversations``."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("content"), F.col("turn").alias("start"), "role", "text")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """A correction log made of ``events``, in order of time: seq, op, entity, member."""
    e = table(spark, folder, "events")
    op = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "set").otherwise("add")
    return e.select(F.struct("ts", "event_id").alias("seq"), "event_id", op.alias("op"), F.col("user_id").alias("entity"), (F.col("event_id") % 5).alias("member"), F.floor(F.col("value") * 100.0).cast("long").alias("value"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Media files made of ``orders``, in folders of numbered names: two fifths are undated, a quarter has no place, and a
    seventeenth was last written on one day."""
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    name = (
        F.when(k % 11 == 0, F.concat(F.lit("Screenshot_"), k.cast("string"), F.lit(".png")))
        .when(k % 11 == 1, F.concat(F.lit("feedfacefeedface"), (k % 10).cast("string"), F.lit(".jpg")))
        .when(k % 11 == 2, F.concat(F.lit("art"), (k % 90).cast("string"), F.lit(".gif")))
        .when(k % 11 == 3, "plain.jpg")
        .otherwise(F.concat(F.lit("IMG_"), F.lpad(k.cast("string"), 9, "0"), F.lit(".jpg")))
    )
    at = F.to_timestamp_ntz(F.col("o_orderdate").cast("string")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 37 % 86400).cast("decimal(18,6)"))
    dated, located = k % 5 > 1, k % 4 != 0
    rows = o.select(
        k.alias("id"),
        F.sha2(k.cast("string"), 256).alias("content_hash"),
        name.alias("name"),
        F.when(k % 13 == 0, "Takeout/Gemini Apps").otherwise(F.concat(F.lit("Photos/c"), (F.col("o_custkey") % 20).cast("string"))).alias("folder"),
        F.when(dated, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("value"),
        F.when(k % 17 == 0, "2001-01-01").otherwise(F.date_format(F.date_add(F.to_date("o_orderdate"), (k % 3).cast("int")), "yyyy-MM-dd")).alias("modified"),
        (k % 29 == 0).alias("dismissed"),
        F.when(located, (F.col("o_custkey") % 3).cast("double") * 10.0 + 0.05).alias("lat"),
        F.when(located, (F.col("o_custkey") % 2).cast("double") * 10.0 + 0.05).alias("lon"),
    )
    cell = F.concat_ws(":", F.floor(F.col("lat") * 10.0), F.floor(F.col("lon") * 10.0))
    clock = [F.substring("value", a, 2).cast("int") for a in (12, 15, 18)]
    return rows.select("*", F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("extension"), F.substring("value", 1, 10).alias("day"), F.when(F.col("id") % 7 != 0, clock[0] * 3600 + clock[1] * 60 + clock[2]).alias("second"), F.when(F.col("lat").isNotNull(), cell).alias("cell"))
