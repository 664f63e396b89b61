"""Small example tables and generated ones of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toy_orders(spark: SparkSession) -> DataFrame:
    """The six example orders, the last two being the test part."""
    rows = [(1, "pen", 2, "2020-04-03", False), (2, "cup", 3, "2020-04-04", False), (3, "cup", 5, "2020-04-04", True), (4, "spoon", 1, "2020-04-05", False), (5, "cup", 5, "2020-04-11", True), (6, "fork", 2, "2020-04-12", False)]
    return spark.createDataFrame(rows, "ID int, product string, quantity int, date string, delayed boolean")


def toy_products(spark: SparkSession) -> DataFrame:
    rows = [("blue pen", 1.5, "anna", "office"), ("tea cup", 4.0, "bob", "kitchen"), ("soup spoon", 2.5, "bob", "kitchen"), ("salad fork", 2.5, "anna", "kitchen"), ("note book", 3.0, "eve", "office"), ("desk lamp", 25.0, "eve", "office")]
    return spark.createDataFrame(rows, "description string, price double, seller string, category string")


def toy_cities(spark: SparkSession, n_rows: int = 1000, null_share: float = 0.1, n_metrics: int = 3, seed: int = 0) -> DataFrame:
    cities = F.array(*[F.lit(c) for c in ("Paris", "London", "Berlin", "Madrid", "Rome")])
    draw = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(5)).cast("int")
    null = lambda j: F.pmod(F.xxhash64("uid", F.lit(seed + j)), F.lit(1000)) < int(null_share * 1000)
    start = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("uid") * 3600)
    out = spark.range(n_rows).withColumnRenamed("id", "uid").select(
        "uid", F.when(~null(1), F.get(cities, draw)).alias("cities"), F.when(~null(2), draw).alias("encoded_cities"), start.alias("start"),
        F.when(~null(3), start + F.expr("interval 1 hour")).alias("end"), *[(F.pmod(F.xxhash64("uid", F.lit(seed + 10 + j)), F.lit(10_000)) / 100.0).alias(f"metric_{j}") for j in range(n_metrics)],
    )
    return out


def make_deduplication_data(spark: SparkSession, examples: list[str], entries_per_example: list[int], prob_mistake_per_letter: float = 0.2, seed: int = 0) -> DataFrame:
    """Each example repeated, with letters replaced at random; rows are made on the executors."""
    if len(examples) != len(entries_per_example):
        raise ValueError("an entry count is needed for each example")
    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyz"), "")
    each = spark.createDataFrame(list(zip(examples, map(int, entries_per_example), strict=True)), "example string, n int").where("n > 0")
    rows = each.select("example", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    draw = lambda i, j: F.pmod(F.xxhash64("example", "copy", i, F.lit(seed + j)), F.lit(1_000_000))
    wrong = lambda c, i: F.when(draw(i, 0) < int(prob_mistake_per_letter * 1_000_000), F.get(letters, (draw(i, 1) % 26).cast("int"))).otherwise(c)
    return rows.select(F.array_join(F.transform(F.split("example", ""), wrong), "").alias("value"))


def make_retail_events(spark: SparkSession, n_users: int = 200, n_events: int = 5000, seed: int = 0) -> DataFrame:
    """Visits to a shop: events of users over time, and whether they bought."""
    pick = lambda j, *values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64("id", F.lit(seed + j)), F.lit(len(values))).cast("int"))
    share = lambda j: F.pmod(F.xxhash64("id", F.lit(seed + j)), F.lit(100_000)) / 100_000.0
    return spark.range(n_events).select(
        F.concat(F.lit("user_"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_users)).cast("string")).alias("user_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (share(1) * 30 * 86_400).cast("long")).alias("timestamp"),
        pick(2, "mobile", "desktop", "tablet").alias("device_type"), pick(3, "home", "toys", "books").alias("page_category"), pick(4, "view", "cart", "search").alias("event_type"),
        (share(5) * 300).alias("time_on_page"), (share(6) * 100).alias("price_viewed"), (share(7) < 0.1).alias("converted"),
    )
