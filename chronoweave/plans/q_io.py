"""Queries of sinks, sessions, streams and whole pipelines, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.functions import allen
from chronoweave.operators import evaluation, graphs, narrative, stories
from chronoweave.sources import benchmark, graphs_io
from chronoweave.sources.stories import candidate_pairs
from chronoweave.streaming import incremental

from . import pipelines, views
from .q_graph import CHAIN, FIRST
from .q_narrative import _EV, _GOLD, _PAIRS, _PLACED, RECORD, _events, _links, _nested, _pairs, _record_sql, _rounded, _threads_predicted, _within, record
from .staging import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _timed(spark, d, k=5):
    ev = views.split_events(spark, d, k)
    return ev.select("doc_id", "event_id", "ord", "description", F.col("ts").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"), F.lit(None).cast("bigint").alias("duration_us"))


@query("dot_lines", f"""WITH {CHAIN.format(k=5, rel=1)} SELECT doc_id, 'digraph TemporalGraph {{' AS line FROM (SELECT DISTINCT doc_id FROM ev) UNION ALL SELECT doc_id, '  rankdir="LR";' FROM (SELECT DISTINCT doc_id FROM ev) UNION ALL SELECT doc_id, '  node [shape="box", style="rounded"];' FROM (SELECT DISTINCT doc_id FROM ev) UNION ALL SELECT doc_id, '}}' FROM (SELECT DISTINCT doc_id FROM ev)
  UNION ALL SELECT doc_id, '  "' || event_id || '" [label="' || event_id || '\\n(' || event_type || ')"];' FROM ev
  UNION ALL SELECT doc_id, '  "' || src || '" -> "' || tgt || '" [label="before", style=solid, color="black"];' FROM chain
  UNION ALL SELECT doc_id, '  "' || tgt || '" -> "' || src || '" [label="after", style=dashed, color="blue"];' FROM chain""")
def _(spark, d):
    e = graphs.closure(views.chain_edges(spark, d, 5), allen.core_dim(spark), transitive=False)
    return graphs_io.dot_lines(_timed(spark, d), e).select("doc_id", "line")


@query("graph_json", f"""WITH {CHAIN.format(k=3, rel=1)}, v AS (SELECT doc_id, string_agg('{{"event_id":"' || event_id || '","description":"' || event_type || '","start_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","end_time":null,"duration":null}}', ', ' ORDER BY ord) AS s FROM ev GROUP BY 1),
e AS (SELECT doc_id, string_agg('{{"source_id":"' || src || '","target_id":"' || tgt || '","relation":"before","is_inferred":false,"confidence":1.0,"provenance":"explicit"}}', ', ' ORDER BY ord) AS s FROM chain GROUP BY 1)
SELECT doc_id, '{{"events": [' || v.s || '], "edges": [' || coalesce(e.s, '') || ']}}' AS graph FROM v LEFT JOIN e USING (doc_id)""")
def _(spark, d):
    return graphs_io.graph_json(_timed(spark, d, 3), views.chain_edges(spark, d, 3))


@query("event_json_roundtrip", f"WITH {FIRST.format(k=5)} SELECT doc_id, event_id, event_type AS description, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_time FROM ev")
def _(spark, d):
    rows = _timed(spark, d).select("doc_id", graphs_io.event_json().alias("j"))
    return rows.select("doc_id", graphs_io.parse_event(F.col("j")).alias("e")).select("doc_id", "e.event_id", "e.description", F.date_format("e.start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"))


@query("candidate_shapes", "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'a-b' WHEN 1 THEN 'c-d' WHEN 2 THEN 'x-y,x-z,y-z' ELSE '' END AS pairs FROM customer")
def _(spark, d):
    """The three shapes of candidates as VARIANT, and a malformed one."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, '[["a", "b"]]').when(k % 4 == 1, '[{"node_i": "c", "node_j": "d"}]').when(k % 4 == 2, '[{"members": ["x", "y", "z"], "shared_detail": "same"}]').otherwise('["alone", 5]')
    pairs = candidate_pairs(F.parse_json(text))
    return views.table(spark, d, "customer").select(k.alias("k"), F.array_join(F.transform(pairs, lambda p: F.array_join(p, "-")), ",").alias("pairs"))


@query("stream_incremental_closure", f"WITH RECURSIVE {CHAIN.format(k=5, rel=1)}, c AS (SELECT doc_id, src, tgt FROM chain UNION SELECT c.doc_id, c.src, h.tgt FROM c JOIN chain h ON c.doc_id = h.doc_id AND c.tgt = h.src) SELECT doc_id, src, tgt, 'before' AS relation FROM c UNION ALL SELECT doc_id, tgt, src, 'after' FROM c")
def _(spark, d):
    """Chain edges as a stream of two files, one micro-batch each."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = views.chain_edges(spark, d, 5).select("doc_id", "src", "tgt", "rel", "ord")
    for part in (rows.where("ord % 2 = 1"), rows.where("ord % 2 = 0")):
        part.select("doc_id", "src", "tgt", "rel").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("doc_id bigint, src string, tgt string, rel int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = incremental.run_available(incremental.closure_stream(stream, allen.core_dim(spark)), path)
    return got.select("doc_id", "src", "tgt", allen.label(F.col("rel")).alias("relation"))


@query("stream_window_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """Daily counts through a watermark; a marker in a later batch closes the windows and isn't counted."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ev = views.table(spark, d, "events").select("ts", "event_type")
    marker = ev.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit("end of stream").alias("event_type"))
    for part in (ev, marker):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = incremental.run_available(incremental.relation_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))), path)
    return got.where("event_type <> 'end of stream'").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("pipeline_finish", f"WITH {_EV} SELECT story_id, count(*) AS n_events, count(DISTINCT thread_id) AS n_threads FROM ev GROUP BY 1")
def _(spark, d):
    """Repair, ordering, verification and merging of every story; the order holds each event once."""
    ev, pairs, _ = _pairs(spark, d)
    gold = stories.gold_edges(_links(ev), ev)
    done = pipelines.finish(ev.select("story_id", "id", "thread_id"), gold, pairs.withColumn("ord", F.lit(1).cast("bigint")))["stories"]
    return done.select("story_id", F.size(F.array_distinct("global_order")).cast("long").alias("n_events"), F.size("thread_orders").cast("long").alias("n_threads"))


@query("pooled_report", f"""WITH {_PAIRS}, pc AS (SELECT 'made' AS condition, * FROM pp UNION ALL SELECT 'gold', * FROM gp), gc AS (SELECT c AS condition, gp.* FROM gp, (SELECT unnest(['made', 'gold']) AS c)),
  ky AS (SELECT condition, story_id FROM pc UNION SELECT condition, story_id FROM gc), n AS (SELECT condition, story_id::VARCHAR AS story_id, (SELECT count(*) FROM gc WHERE gc.condition = ky.condition AND gc.story_id = ky.story_id) AS g, (SELECT count(*) FROM pc WHERE pc.condition = ky.condition AND pc.story_id = ky.story_id) AS p,
    (SELECT count(*) FROM gc JOIN pc USING (condition, story_id, a, b) WHERE gc.condition = ky.condition AND gc.story_id = ky.story_id) AS h FROM ky),
  t AS (SELECT * FROM n UNION ALL SELECT condition, NULL, sum(g)::BIGINT, sum(p)::BIGINT, sum(h)::BIGINT FROM n GROUP BY 1),
  v AS (SELECT *, CASE WHEN g = 0 OR p = 0 THEN 0.0 ELSE h / p END AS pr, CASE WHEN g = 0 OR p = 0 THEN 0.0 ELSE h / g END AS rc FROM t)
  SELECT condition, story_id, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 9)::DOUBLE AS f1, g AS n_gold, p AS n_predicted FROM v""")
def _(spark, d):
    _, gold, made = _pairs(spark, d)
    predicted = made.withColumn("condition", F.lit("made")).unionByName(gold.withColumn("condition", F.lit("gold")))
    return _rounded(pipelines.pooled_report(gold, predicted), "precision", "recall", "f1")


@query("rescore_stories", RECORD + _record_sql("SELECT story_id, 1.0 AS relation_score FROM st", "SELECT * FROM true_pool WHERE false"))
def _(spark, d):
    """Gold relations under predicted threads and pairs, without a pool."""
    ev, pairs, made = _pairs(spark, d)
    gold = stories.gold_edges(_links(ev), ev)
    order = narrative.finish(_nested(spark, d)).select("story_id", F.posexplode("global_order").alias("position", "id"))
    return record(pipelines.rescore({"events": ev, "edges": gold, "pairs": pairs}, {"events": _threads_predicted(ev), "edges": gold, "pairs": made, "order": order}))


@query("linear_variant", f"""WITH {_GOLD}, {_PLACED}, li AS (SELECT story_id, id, row_number() OVER (PARTITION BY story_id ORDER BY thread_id, place) AS nth FROM tp)
  SELECT g.story_id, 's' || a.nth AS node_i, 's' || b.nth AS node_j FROM gold g JOIN li a ON a.story_id = g.story_id AND a.id = g.node_i JOIN li b ON b.story_id = g.story_id AND b.id = g.node_j""")
def _(spark, d):
    """Edges under linear ids; without anchors the threads follow one another."""
    ev, pairs, _ = _pairs(spark, d)
    gold = stories.gold_edges(_links(ev), ev).select("story_id", "node_i", "node_j", "rel", "ord")
    inner = _within(ev).select("story_id", "node_i", "node_j", "rel", (F.col("ord") + 1000).alias("ord"))
    both = gold.unionByName(inner)
    new = pipelines.linearize(ev.select("story_id", "id", "thread_id"), both, pairs.limit(0).withColumn("ord", F.lit(1).cast("bigint")))
    return new["edges"].where("ord < 1000").select("story_id", "node_i", "node_j")


@query("bench_report", """SELECT * FROM (VALUES ('Total Examples:          150'), ('Overall Accuracy:        100.0%'), ('Explicit Accuracy:       100.0%'), ('Inference Accuracy:      100.0%'), ('Consistency Rate:        100.0%'),
 ('Macro Precision:         1.000'), ('Macro Recall:            1.000'), ('Macro F1 Score:          1.000')) t(line)""")
def _(spark, d):
    detail = evaluation.evaluate(benchmark.generate(spark))
    return evaluation.report(detail).where("line_no BETWEEN 3 AND 10").select("line")


