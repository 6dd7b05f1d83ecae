"""Event graphs as text: JSON, Graphviz DOT, whole-file statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import allen

EVENT = "event_id string, description string, start_time string, end_time string, duration double"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one statement block: doc_id (its path), epoch 0, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.lit(0).alias("epoch"), F.col("value").alias("text"))


def inline(spark: SparkSession, texts: list[str], doc_id: str = "inline") -> DataFrame:
    return spark.createDataFrame([(doc_id, i, t) for i, t in enumerate(texts)], "doc_id string, epoch int, text string")


def _iso(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def event_json(event_columns: bool = True) -> Column:
    """An event row as JSON; zero durations count as none."""
    seconds = F.nullif(F.col("duration_us"), F.lit(0)) / 1_000_000
    fields = F.struct("event_id", "description", _iso("start_time").alias("start_time"), _iso("end_time").alias("end_time"), seconds.alias("duration"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def parse_event(text: Column) -> Column:
    """struct<event_id, description, start_time, end_time, duration_us> of an event's JSON."""
    e = F.from_json(text, EVENT)
    return F.struct(e["event_id"].alias("event_id"), F.coalesce(e["description"], F.lit("")).alias("description"), e["start_time"].try_cast("timestamp_ntz").alias("start_time"), e["end_time"].try_cast("timestamp_ntz").alias("end_time"), (e["duration"] * 1_000_000).cast("long").alias("duration_us"))


def edge_json() -> Column:
    fields = F.struct(F.col("src").alias("source_id"), F.col("tgt").alias("target_id"), allen.label(F.col("rel")).alias("relation"), "is_inferred", "confidence", "provenance")
    return F.to_json(fields)


def graph_json(events: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, graph: one JSON document of all events and edges of a graph."""
    part = lambda df, json, kind: df.select("doc_id", F.lit(kind).alias("kind"), F.struct("ord", json.alias("json")).alias("x"))
    rows = part(events, event_json(), "events").unionByName(part(edges, edge_json(), "edges"))
    lists = rows.groupBy("doc_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))), lambda x: x["json"]), ", ").alias(k) for k in ("events", "edges")])
    return lists.select("doc_id", F.concat(F.lit('{"events": ['), "events", F.lit('], "edges": ['), "edges", F.lit("]}")).alias("graph"))


def dot_lines(events: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, line_no, line of Graphviz DOT: explicit edges solid and black, inferred ones dashed and blue."""
    docs = events.select("doc_id").distinct()
    at = lambda n, text: docs.select("doc_id", F.struct(F.lit(n).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(text).alias("line")).alias("x"))
    node = F.format_string('  "%s" [label="%s\\n(%s)"];', "event_id", "event_id", "description")
    style = F.when(F.col("is_inferred"), F.lit('dashed, color="blue"')).otherwise(F.lit('solid, color="black"'))
    arrow = F.format_string('  "%s" -> "%s" [label="%s", style=%s];', "src", "tgt", allen.label(F.col("rel")), style)
    rows = at(0, "digraph TemporalGraph {").unionByName(at(1, '  rankdir="LR";')).unionByName(at(2, '  node [shape="box", style="rounded"];'))
    rows = rows.unionByName(events.select("doc_id", F.struct(F.lit(3).alias("part"), F.col("ord"), node.alias("line")).alias("x")))
    rows = rows.unionByName(edges.select("doc_id", F.struct(F.lit(4).alias("part"), F.col("ord"), arrow.alias("line")).alias("x"))).unionByName(at(5, "}"))
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("doc_id", F.posexplode("x").alias("line_no", "x"))
    return lines.select("doc_id", "line_no", F.col("x.line").alias("line"))
