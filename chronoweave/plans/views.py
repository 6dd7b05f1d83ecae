"""Interval views and event graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import allen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_type_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a user, one event an event type, from its first to its last day."""
    days = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_type"))
    return days.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("event_id"), rank.cast("long").alias("ord"), F.col("event_type").alias("description"), day("a").alias("start_time"), day("b").alias("end_time"), F.lit(None).cast("long").alias("duration_us"))


def order_ship_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a customer, one event an order, from its first to its last shipment."""
    ship = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    got = orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return got.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("ord"), F.col("s").alias("start_time"), F.col("e").alias("end_time"))


def pairs(events: DataFrame) -> DataFrame:
    """Unordered pairs of a document's events with both intervals."""
    a = events.select("doc_id", F.col("event_id").alias("a"), F.col("start_time").alias("s1"), F.col("end_time").alias("e1"), F.col("ord").alias("o1"))
    b = events.select("doc_id", F.col("event_id").alias("b"), F.col("start_time").alias("s2"), F.col("end_time").alias("e2"), F.col("ord").alias("o2"))
    return a.join(b, "doc_id").where("o1 < o2").withColumn("rel", allen.relation(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tracked event with a duration of `value` minutes and no end."""
    minutes = F.floor(F.col("value")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("description"), F.col("ts").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"), (minutes * 60000000).alias("duration_us"))


#: Documents of one user are numbered from user_id times this.
PARTS = 100_000


def split_events(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every event, each user's in documents of k in a row by time (the last may be shorter): doc_id, event_id, ord (1..k)."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    got = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("event_id"), "ts", F.col("event_type").alias("description"), "value", nth.cast("long").alias("_nth"))
    doc = (F.col("user_id") * PARTS + F.floor(F.col("_nth") / k)).cast("long")
    return got.select(doc.alias("doc_id"), "event_id", "ts", "description", "value", (F.col("_nth") % k + 1).alias("ord"))


def chain_edges(spark: SparkSession, sf_dir: str, k: int, rel: str = "before") -> DataFrame:
    """Explicit edges between consecutive events of each document of k events."""
    ev = split_events(spark, sf_dir, k).select("doc_id", "event_id", "ord")
    nxt = F.lead("event_id").over(Window.partitionBy("doc_id").orderBy("ord"))
    e = ev.withColumn("tgt", nxt).where("tgt IS NOT NULL")
    return as_edges(e.select("doc_id", F.col("event_id").alias("src"), "tgt", F.lit(allen.ID[rel]).alias("rel"), "ord"))


def as_edges(rows: DataFrame) -> DataFrame:
    """Explicit edges of doc_id, src, tgt, rel, ord."""
    return rows.select("doc_id", "src", "tgt", F.col("rel").cast("int").alias("rel"), F.lit(False).alias("is_inferred"), F.lit(1.0).alias("confidence"), F.lit("explicit").alias("provenance"), F.col("ord").cast("long").alias("ord"))


def seeded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of five events with contradictions seeded by the document's number.

    modulo 5: 0 a cycle back to the first, 1 a second edge that turns the first around, 2 a self loop, 3 after beside
    before on the same pair, 4 equal beside before and meets; none for every seventh document.
    """
    ev = split_events(spark, sf_dir, 5)
    at = lambda n: F.max(F.when(F.col("ord") == n, F.col("event_id")))
    wide = ev.groupBy("doc_id").agg(*[at(n).alias(f"e{n}") for n in range(1, 6)])
    chain = chain_edges(spark, sf_dir, 5)
    extra = {0: (("e5", "e1", "before"),), 1: (("e2", "e1", "before"),), 2: (("e3", "e3", "before"),), 3: (("e1", "e2", "after"),), 4: (("e1", "e2", "equal"), ("e1", "e2", "meets"))}
    more = F.lit(None).cast("array<struct<src:string,tgt:string,rel:int,ord:bigint>>")
    for m, rows in extra.items():
        made = F.array(*[F.struct(F.col(s).alias("src"), F.col(t).alias("tgt"), F.lit(allen.ID[r]).alias("rel"), F.lit(100 + i).cast("long").alias("ord")) for i, (s, t, r) in enumerate(rows)])
        more = F.when((F.col("doc_id") % 5 == m) & (F.col("doc_id") % 7 != 0), made).otherwise(more)
    seeds = wide.select("doc_id", F.explode(more).alias("x")).select("doc_id", "x.*").where("src IS NOT NULL AND tgt IS NOT NULL")
    return chain.unionByName(as_edges(seeds))
