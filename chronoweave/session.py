"""A session over many event graphs: statements and relations in, answers, explanations and contradictions out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import allen
from chronoweave.operators import evaluation, graphs, statements
from chronoweave.plans.staging import stage
from chronoweave.sources import benchmark, graphs_io


class TemporalSession:
    """Graphs by doc_id. What is added is kept as tables; inference runs when a result is asked for."""

    def __init__(self, spark: SparkSession, anchor: datetime | None = None, full_composition: bool = False, doc_type: str = "string"):
        self.spark, self.anchor, self.doc_type = spark, anchor, doc_type
        self.dim = stage((allen.full_dim if full_composition else allen.core_dim)(spark), "dim")
        allen.register(spark)
        self.reset()

    def reset(self) -> None:
        """Forget all statements, events and relations."""
        d = self.doc_type
        self._said = self.spark.createDataFrame([], f"doc_id {d}, epoch int, text string")
        self._events = self.spark.createDataFrame([], f"doc_id {d}, event_id string, ord bigint, description string, start_time timestamp_ntz, end_time timestamp_ntz, duration_us bigint")
        self._edges = self.spark.createDataFrame([], f"doc_id {d}, src string, tgt string, rel int, is_inferred boolean, confidence double, provenance string, ord bigint")
        self._graph: tuple[DataFrame, DataFrame, DataFrame] | None = None
        self._calls = 0

    def add_statements(self, rows: DataFrame) -> None:
        """rows: doc_id, epoch, text; epochs continue those of earlier calls."""
        self._calls += 1
        moved = rows.select(F.col("doc_id").cast(self.doc_type).alias("doc_id"), (F.col("epoch") + self._calls * 1_000_000).cast("int").alias("epoch"), "text")
        self._said, self._graph = stage(self._said.unionByName(moved), "said"), None

    def add_statement(self, text: str, doc_id: str = "inline") -> None:
        self.add_statements(graphs_io.inline(self.spark, [text], doc_id))

    def add_events(self, events: DataFrame) -> None:
        broken = graphs.validation(events)
        if not broken.isEmpty():
            raise ValueError(f"invalid events: {[r.asDict() for r in broken.limit(5).collect()]}")
        self._events, self._graph = self._events.unionByName(events.select(*self._events.columns)), None

    def add_relation(self, src: str, tgt: str, relation: str, doc_id: str = "inline") -> None:
        name = relation.strip().lower().replace("-", "_").replace(" ", "_")
        rel = allen.ID.get(allen.ALIASES.get(name, name))
        if rel is None:
            raise ValueError(f"unknown relation {relation!r}")
        self._calls += 1
        row = self.spark.createDataFrame([(doc_id, src, tgt, rel, False, 1.0, "explicit", self._calls)], self._edges.schema)
        self._edges, self._graph = self._edges.unionByName(row), None

    def infer(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(parsed sentences, events, closed edges)."""
        if self._graph is None:
            parsed, events, edges = statements.graph(self._said, self.anchor, self.dim)
            named = graphs.resolve(self._edges.select("doc_id", F.explode(F.array("src", "tgt")).alias("item")).distinct(), events.unionByName(self._events, allowMissingColumns=True))
            to = lambda df, c: df.join(named.select("doc_id", F.col("item").alias(c), F.col("event_id").alias("_id")), ["doc_id", c]).withColumn(c, F.col("_id")).drop("_id")
            given = to(to(self._edges, "src"), "tgt").select(*graphs.EDGE)
            known = events.select(*self._events.columns).unionByName(self._events)
            seen = known.select("doc_id", "event_id")
            fresh = given.select("doc_id", F.explode(F.array("src", "tgt")).alias("event_id")).distinct().join(seen, ["doc_id", "event_id"], "left_anti")
            bare = fresh.select("doc_id", "event_id", F.lit(1 << 40).alias("ord"), F.col("event_id").alias("description"), F.lit(None).cast("timestamp_ntz").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"), F.lit(None).cast("bigint").alias("duration_us"))
            every = stage(known.unionByName(bare), "events")
            closed = graphs.closure(edges.select(*graphs.EDGE).unionByName(given), self.dim, every)
            self._graph = parsed, graphs.complete_bounds(every), closed
        return self._graph

    @property
    def events(self) -> DataFrame:
        return self.infer()[1]

    @property
    def edges(self) -> DataFrame:
        return self.infer()[2]

    def query_all(self, pairs: DataFrame) -> DataFrame:
        """pairs (doc_id, source, target; ids or descriptions) with relation, is_inferred and provenance."""
        _, events, edges = self.infer()
        names = pairs.select("doc_id", F.explode(F.array("source", "target")).alias("item")).distinct()
        ids = graphs.resolve(names, events)
        to = lambda c, new: ids.select("doc_id", F.col("item").alias(c), F.col("event_id").alias(new))
        asked = pairs.join(to("source", "src"), ["doc_id", "source"]).join(to("target", "tgt"), ["doc_id", "target"])
        got = graphs.answer(asked, edges)
        return got.select("doc_id", "source", "target", allen.label(F.col("rel")).alias("relation"), "is_inferred", "provenance")

    def query(self, source: str, target: str, doc_id: str = "inline") -> str | None:
        row = self.query_all(self.spark.createDataFrame([(doc_id, source, target)], f"doc_id {self.doc_type}, source string, target string")).first()
        return row.relation if row else None

    def explain(self, source: str, target: str, doc_id: str = "inline") -> str | None:
        row = self.query_all(self.spark.createDataFrame([(doc_id, source, target)], f"doc_id {self.doc_type}, source string, target string")).first()
        return row.provenance if row else None

    def conflicts(self) -> DataFrame:
        return graphs.conflicts(self.edges, self.events)

    def is_consistent(self, doc_id: str | None = None) -> bool:
        found = self.conflicts()
        return (found if doc_id is None else found.where(F.col("doc_id") == doc_id)).isEmpty()

    def evaluate(self, path: str | None = None) -> DataFrame:
        """Evaluation rows of a benchmark file, or of the generated benchmark."""
        return evaluation.evaluate(benchmark.read(self.spark, path) if path else benchmark.generate(self.spark))

    def dot(self) -> DataFrame:
        return graphs_io.dot_lines(self.events, self.edges)
