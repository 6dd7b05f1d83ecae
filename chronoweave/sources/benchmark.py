"""The generated benchmark of relation questions, as a table, and its file form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, category string, statements array<string>, query array<string>, expected string, is_consistent boolean"


def generate(spark: SparkSession) -> DataFrame:
    """150 examples of eight kinds, each kind numbered from 1."""
    i = F.col("id").cast("int")
    name = lambda stem: F.concat(F.lit(stem + "_"), i.cast("string"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("."))
    odd = i % 2 == 1

    def rows(n, prefix, category, statements, query, expected, consistent=True):
        return spark.range(1, n + 1).select(
            F.concat(F.lit(prefix + "_"), F.lpad(i.cast("string"), 3, "0")).alias("id"), F.lit(category).alias("category"), statements.alias("statements"),
            F.array(*query).alias("query"), expected.cast("string").alias("expected"), F.lit(consistent).alias("is_consistent"),
        )

    a, b, c = name("OrderA"), name("OrderB"), name("OrderC")
    way = F.when(odd, "before").otherwise("after")
    order = rows(25, "eo", "event ordering", F.array(said(a, " ", way, " ", b), said(b, " ", way, " ", c)), (a, c), way)
    a, b, c, d = (name(f"Trans{x}") for x in "ABCD")
    chain = rows(25, "ti", "transitive inference", F.array(said(a, " before ", b), said(b, " before ", c), said(c, " before ", d)), (a, d), F.lit("before"))
    a, b = name("InvA"), name("InvB")
    inverse = rows(20, "ir", "inverse relations", F.array(said(a, " ", F.when(odd, "before").otherwise("during"), " ", b)), (b, a), F.when(odd, "after").otherwise("contains"))
    a, b = name("IntervalA"), name("IntervalB")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("meets", "during", "contains", "equal")]), i % 4 + 1)
    interval = rows(20, "int", "interval relations", F.array(said(a, " ", kind, " ", b)), (a, b), kind)
    a, b = name("MeetingA"), name("MeetingB")
    relative = rows(15, "rd", "relative dates", F.array(said(a, " happened ", (i + 1).cast("string"), " days ago"), said(b, " happened tomorrow")), (a, b), F.lit("before"))
    a, b, hour = name("Lecture"), name("Discussion"), 8 + i % 6
    clock = lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
    lasting = rows(15, "dur", "durations", F.array(said(a, " started at ", clock(hour)), F.lit("It lasted for 60 minutes."), said(b, " started at ", clock(hour + 2))), (a, b), F.lit("before"))
    a, b, c = (name(f"Conflict{x}") for x in "ABC")
    two = F.array(said(a, " before ", b), said(b, " before ", a))
    three = F.array(said(a, " before ", b), said(b, " before ", c), said(c, " before ", a))
    contra = rows(15, "contra", "contradictions", F.when(odd, two).otherwise(three), (a, b), F.lit(None), False)
    a, b = name("Sprint"), name("Release")
    mixed = rows(15, "mix", "mixed temporal expressions", F.array(said(a, " started at 09:00"), F.lit("It lasted for 2 hours."), said(b, " started at 14:00")), (a, b), F.lit("before"))
    out = order
    for part in (chain, inverse, interval, relative, lasting, contra, mixed):
        out = out.unionByName(part)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark file: one JSON array of examples."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def as_statements(examples: DataFrame) -> DataFrame:
    return examples.select(F.col("id").alias("doc_id"), F.posexplode("statements").alias("epoch", "text"))
