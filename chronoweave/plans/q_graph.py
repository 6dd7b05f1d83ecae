"""Queries of the interval algebra and of event graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import allen
from chronoweave.operators import graphs

from . import views

N = ", ".join(f"'{x}'" for x in allen.SYMBOLIC)
N2 = ", ".join(f"'{x}'" for x in allen.RELATIONS)


def sql_rel(s1="s1", e1="e1", s2="s2", e2="e2") -> str:
    """Relation number in SQL, written from the endpoints alone."""
    i = allen.ID
    return f"""CASE WHEN {s1} IS NULL OR {e1} IS NULL OR {s2} IS NULL OR {e2} IS NULL THEN NULL
      WHEN {e1} < {s2} THEN {i['before']} WHEN {e2} < {s1} THEN {i['after']} WHEN {e1} = {s2} THEN {i['meets']} WHEN {e2} = {s1} THEN {i['met_by']}
      WHEN {s1} = {s2} AND {e1} = {e2} THEN {i['equal']} WHEN {s1} = {s2} AND {e1} < {e2} THEN {i['starts']} WHEN {s1} = {s2} THEN {i['started_by']}
      WHEN {e1} = {e2} AND {s1} > {s2} THEN {i['finishes']} WHEN {e1} = {e2} THEN {i['finished_by']}
      WHEN {s1} > {s2} AND {e1} < {e2} THEN {i['during']} WHEN {s1} < {s2} AND {e1} > {e2} THEN {i['contains']}
      WHEN {s1} < {s2} THEN {i['overlaps']} ELSE {i['overlapped_by']} END"""


def sql_label(rel: str, names: str = N) -> str:
    return f"list_extract([{names}], ({rel}) + 1)"


USER_TYPE = "iv AS (SELECT user_id AS doc_id, event_type AS event_id, date_trunc('day', min(ts)) AS s, date_trunc('day', max(ts)) AS e FROM events GROUP BY 1, 2)"
USER_PAIRS = f"{USER_TYPE}, p AS (SELECT a.doc_id, a.event_id AS a, b.event_id AS b, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM iv a JOIN iv b ON a.doc_id = b.doc_id AND a.event_id < b.event_id)"
ORDER_SHIP = "iv AS (SELECT o_custkey AS doc_id, o_orderkey AS k, min(l_shipdate) AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
FIRST = "ev AS (SELECT user_id * 100000 + nth // {k} AS doc_id, event_id, ts, event_type, value, nth % {k} + 1 AS ord FROM (SELECT user_id, event_id::VARCHAR AS event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events))"
CHAIN = FIRST + ", chain AS (SELECT a.doc_id, a.event_id AS src, b.event_id AS tgt, {rel} AS rel, a.ord FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1)"
SEEDED = (
    CHAIN.format(k=5, rel=1)
    + ", w AS (SELECT doc_id, "
    + ", ".join(f"max(CASE WHEN ord = {n} THEN event_id END) AS e{n}" for n in range(1, 6))
    + """ FROM ev GROUP BY 1), seeds AS (
  SELECT doc_id, e5 AS src, e1 AS tgt, 1 AS rel, 100 AS ord FROM w WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0
  UNION ALL SELECT doc_id, e2, e1, 1, 100 FROM w WHERE doc_id % 5 = 1 AND doc_id % 7 <> 0
  UNION ALL SELECT doc_id, e3, e3, 1, 100 FROM w WHERE doc_id % 5 = 2 AND doc_id % 7 <> 0
  UNION ALL SELECT doc_id, e1, e2, 2, 100 FROM w WHERE doc_id % 5 = 3 AND doc_id % 7 <> 0
  UNION ALL SELECT doc_id, e1, e2, 0, 100 FROM w WHERE doc_id % 5 = 4 AND doc_id % 7 <> 0
  UNION ALL SELECT doc_id, e1, e2, 3, 101 FROM w WHERE doc_id % 5 = 4 AND doc_id % 7 <> 0
), edges AS (SELECT * FROM chain UNION ALL SELECT * FROM seeds WHERE src IS NOT NULL AND tgt IS NOT NULL)"""
)
#: Representative intervals: every pair of intervals over 0..7 against [2, 5] gives all relations.
REPS = f"g AS (SELECT a.range AS s1, b.range AS e1 FROM range(8) a, range(8) b WHERE a.range < b.range), reps AS (SELECT {sql_rel('s1', 'e1', '2', '5')} AS rel, min(s1) AS s1, min_by(e1, s1 * 10 + e1) AS e1 FROM (SELECT * FROM g ORDER BY s1, e1) GROUP BY 1)"
COMPOSE = f"""iv16 AS (SELECT a.range AS s, b.range AS e FROM range(16) a, range(16) b WHERE a.range < b.range),
compose AS (SELECT {sql_rel('a.s', 'a.e', '5', '10')} AS r1, {sql_rel('5', '10', 'c.s', 'c.e')} AS r2, bit_or(1 << ({sql_rel('a.s', 'a.e', 'c.s', 'c.e')})) AS mask FROM iv16 a, iv16 c GROUP BY 1, 2)"""
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def label(c: str = "rel", names=allen.SYMBOLIC):
    return allen.label(F.col(c), names)


def _n():
    return F.count(F.lit(1)).alias("n")


@query("allen_hist_user_types", f"WITH {USER_PAIRS} SELECT {sql_label(sql_rel())} AS relation, count(*) AS n FROM p GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.pairs(views.user_type_events(spark, d)).groupBy(label().alias("relation")).agg(_n())


@query("allen_hist_orders", f"WITH {ORDER_SHIP} SELECT {sql_label(sql_rel('a.s', 'a.e', 'b.s', 'b.e'))} AS relation, count(*) AS n FROM iv a JOIN iv b ON a.doc_id = b.doc_id AND a.k < b.k GROUP BY 1")
def _(spark, d):
    return views.pairs(views.order_ship_events(spark, d)).groupBy(label().alias("relation")).agg(_n())


@query("allen_pairs_detail", f"WITH {USER_PAIRS} SELECT doc_id, a, b, {sql_label(sql_rel())} AS relation FROM p")
def _(spark, d):
    return views.pairs(views.user_type_events(spark, d)).select("doc_id", "a", "b", label().alias("relation"))


@query("allen_l2_labels", f"WITH {USER_PAIRS} SELECT coalesce(CASE WHEN s1 < e1 AND s2 < e2 THEN {sql_label(sql_rel(), N2)} END, 'degenerate') AS relation, count(*) AS n FROM p GROUP BY 1")
def _(spark, d):
    rel = allen.proper_relation(*[F.col(c) for c in ("s1", "e1", "s2", "e2")])
    return views.pairs(views.user_type_events(spark, d)).groupBy(F.coalesce(allen.label(rel, allen.RELATIONS), F.lit("degenerate")).alias("relation")).agg(_n())


@query("allen_inverse_dim", f"WITH {REPS} SELECT {sql_label('rel', N2)} AS relation, {sql_label(sql_rel('2', '5', 's1', 'e1'), N2)} AS inverse, rel IN (1, 3) AS is_strict, rel = 0 AS is_symmetric FROM reps")
def _(spark, d):
    return allen.relation_dim(spark).select(F.col("name").alias("relation"), label("inverse", allen.RELATIONS).alias("inverse"), F.col("strict").alias("is_strict"), (F.col("rel") == F.col("inverse")).alias("is_symmetric"))


_DIFF = "(sign(a.s1 - 2) <> sign(b.s1 - 2))::INT + (sign(a.s1 - 5) <> sign(b.s1 - 5))::INT + (sign(a.e1 - 2) <> sign(b.e1 - 2))::INT + (sign(a.e1 - 5) <> sign(b.e1 - 5))::INT"


@query("allen_distance_dim", f"WITH {REPS} SELECT {sql_label('a.rel', N2)} AS r1, {sql_label('b.rel', N2)} AS r2, ({_DIFF})::BIGINT AS distance FROM reps a, reps b")
def _(spark, d):
    return allen.distance_dim(spark).select(label("r1", allen.RELATIONS).alias("r1"), label("r2", allen.RELATIONS).alias("r2"), F.col("distance").cast("long"))


@query("allen_score_dim", f"WITH {REPS} SELECT {sql_label('a.rel', N2)} AS r1, {sql_label('b.rel', N2)} AS r2, round(greatest(0.0, 1.0 - ({_DIFF}) / 6.0)::DOUBLE, 9) AS score FROM reps a, reps b")
def _(spark, d):
    return allen.distance_dim(spark).select(label("r1", allen.RELATIONS).alias("r1"), label("r2", allen.RELATIONS).alias("r2"), F.round("score", 9).alias("score"))


@query("allen_composition_dim", f"WITH {COMPOSE} SELECT {sql_label('r1', N2)} AS r1, {sql_label('r2', N2)} AS r2, mask::BIGINT AS mask, bit_count(mask::BIGINT)::BIGINT AS n_relations FROM compose")
def _(spark, d):
    return allen.composition_dim(spark).select(label("r1", allen.RELATIONS).alias("r1"), label("r2", allen.RELATIONS).alias("r2"), F.col("mask").cast("long"), F.bit_count("mask").cast("long").alias("n_relations"))


_CORE_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in allen.CORE)


@query("compose_core_dim", f"SELECT * FROM (VALUES {_CORE_SQL}) t(r1, r2, r3) UNION SELECT 'equal', r, r FROM unnest([{N}]) u(r) UNION SELECT r, 'equal', r FROM unnest([{N}]) u(r)")
def _(spark, d):
    return allen.core_dim(spark).select(*[label(c).alias(c) for c in ("r1", "r2", "r3")])


_NAMES = [*allen.ALIASES, "Before", " MET-BY ", "same time", "overlapped_by", "sideways", "Overlapped By"]


@query(
    "relation_alias_parse",
    "WITH t AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _NAMES) + "]) AS name), a AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in allen.ALIASES.items()) + f") v(alias, relation)) SELECT name, coalesce(relation, CASE WHEN lower(trim(name)) IN ({N}) THEN lower(trim(name)) END) AS relation FROM t LEFT JOIN a ON alias = replace(replace(lower(trim(name)), '-', '_'), ' ', '_')",
)
def _(spark, d):
    return spark.createDataFrame([(x,) for x in _NAMES], "name string").select("name", allen.label(allen.parse_relation(F.col("name"))).alias("relation"))


@query("bounds_completion", "SELECT event_id::VARCHAR AS event_id, strftime(CASE WHEN floor(value) <> 0 THEN ts + to_minutes(floor(value)::BIGINT) END, '%Y-%m-%d %H:%M:%S') AS end_time, (floor(value)::BIGINT * 60)::BIGINT AS seconds FROM events")
def _(spark, d):
    got = graphs.complete_bounds(views.span_events(spark, d))
    return got.select("event_id", F.date_format("end_time", "yyyy-MM-dd HH:mm:ss").alias("end_time"), F.floor(F.col("duration_us") / 1000000).alias("seconds"))


def _order_events(spark, d):
    """Orders as events from order date to first shipment, with a duration that every third states as one day."""
    o, l = views.table(spark, d, "orders"), views.table(spark, d, "lineitem")
    first = l.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("e"))
    got = o.join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.when(F.col("o_orderkey") % 3 == 0, F.lit(86400000000))
    return got.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("start_time"), F.col("e").alias("end_time"), F.when(F.col("o_orderkey") % 11 == 0, F.lit(0)).when(F.col("o_orderkey") % 13 == 0, F.lit(-5)).otherwise(day).cast("long").alias("duration_us"))


_ORDER_SQL = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS event_id, o_orderdate AS s, min(l_shipdate) AS e,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN -5 WHEN o_orderkey % 3 = 0 THEN 86400000000 END AS d
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"""


@query("event_validation", f"""WITH {_ORDER_SQL} SELECT problem, count(*) AS n FROM (
  SELECT 'start_after_end' AS problem FROM o WHERE s > e
  UNION ALL SELECT 'duration_conflict' FROM o WHERE s <= e AND abs(date_diff('microsecond', s, e) - d) > 1000
  UNION ALL SELECT 'negative_duration' FROM o WHERE d < 0) GROUP BY 1""")
def _(spark, d):
    return graphs.validation(_order_events(spark, d)).groupBy("problem").agg(_n())


@query("event_flags", f"WITH {_ORDER_SQL} SELECT coalesce(s = e OR d = 0, false) AS is_instantaneous, true AS has_bounds, count(*) AS n FROM o GROUP BY 1, 2")
def _(spark, d):
    return graphs.flags(_order_events(spark, d)).groupBy("is_instantaneous", "has_bounds").agg(_n())


def _partial(spark, d):
    """Documents of six events; by position some have no end, some no start."""
    ev = views.split_events(spark, d, 6)
    us = graphs.microseconds(F.col("ts"))
    end = graphs.from_microseconds(us + F.floor("value").cast("long") * 60000000)
    return ev.select("doc_id", "event_id", "ord", "description", F.when(F.col("ord") % 3 != 1, F.col("ts")).alias("start_time"), F.when(F.col("ord") % 3 != 2, end).alias("end_time"))


@query("bound_relations_partial", f"""WITH {FIRST.format(k=6)}, x AS (SELECT doc_id, event_id, ord, CASE WHEN ord % 3 <> 1 THEN ts END AS s, CASE WHEN ord % 3 <> 2 THEN ts + to_minutes(floor(value)::BIGINT) END AS e FROM ev),
p AS (SELECT a.doc_id, a.event_id AS ia, b.event_id AS ib, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.ord < b.ord),
r AS (SELECT *, CASE WHEN s1 IS NOT NULL AND e1 IS NOT NULL AND s2 IS NOT NULL AND e2 IS NOT NULL THEN {sql_rel()}
  WHEN e1 < s2 THEN 1 WHEN e2 < s1 THEN -1 WHEN s1 IS NOT NULL AND s2 IS NOT NULL AND e1 IS NULL AND e2 IS NULL THEN CASE WHEN s1 < s2 THEN 1 WHEN s2 < s1 THEN -1 ELSE 0 END END AS rel FROM p)
SELECT doc_id, CASE WHEN rel = -1 THEN ib ELSE ia END AS src, CASE WHEN rel = -1 THEN ia ELSE ib END AS tgt, {sql_label('abs(rel)')} AS relation FROM r WHERE rel IS NOT NULL""")
def _(spark, d):
    return graphs.bound_edges(_partial(spark, d)).select("doc_id", "src", "tgt", label().alias("relation"))


def _out(edges):
    return edges.select("doc_id", "src", "tgt", label().alias("relation"))


@query("inverse_edges", f"WITH {CHAIN.format(k=5, rel=1)} SELECT doc_id, tgt AS src, src AS tgt, 'after' AS relation FROM chain")
def _(spark, d):
    return _out(graphs.inverse_edges(views.chain_edges(spark, d, 5)))


@query("edge_upsert", f"WITH {SEEDED} SELECT doc_id, src, tgt, {sql_label('rel')} AS relation, min(ord)::BIGINT AS ord FROM edges GROUP BY 1, 2, 3, 4")
def _(spark, d):
    twice = views.seeded_edges(spark, d)
    later = twice.withColumn("ord", F.col("ord") + 1000)
    return graphs.first_edges(twice.unionByName(later)).select("doc_id", "src", "tgt", label().alias("relation"), "ord")


@query("pair_relations", f"WITH {SEEDED} SELECT doc_id, src, tgt, string_agg(DISTINCT {sql_label('rel')}, ',' ORDER BY {sql_label('rel')}) AS relations FROM edges GROUP BY 1, 2, 3")
def _(spark, d):
    got = views.seeded_edges(spark, d).groupBy("doc_id", "src", "tgt").agg(F.array_join(F.array_sort(F.collect_set(label())), ",").alias("relations"))
    return got


def _typed(spark, d):
    """Edges between a user's event types, by their intervals, from each type to the next two."""
    p = views.pairs(views.user_type_events(spark, d)).where("o2 - o1 <= 2")
    return views.as_edges(p.select("doc_id", F.col("a").alias("src"), F.col("b").alias("tgt"), "rel", (F.col("o1") * 10 + F.col("o2")).alias("ord")))


_TYPED = f"{USER_TYPE}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) AS ord FROM iv), typed AS (SELECT a.doc_id, a.event_id AS src, b.event_id AS tgt, {sql_rel('a.s', 'a.e', 'b.s', 'b.e')} AS rel FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.ord BETWEEN a.ord + 1 AND a.ord + 2)"


@query("two_hop_compose", f"WITH {_TYPED}, {COMPOSE} SELECT DISTINCT a.doc_id, a.src, b.tgt, {sql_label('log2(mask)::INT')} AS relation FROM typed a JOIN typed b ON a.doc_id = b.doc_id AND a.tgt = b.src JOIN compose c ON c.r1 = a.rel AND c.r2 = b.rel WHERE bit_count(mask::BIGINT) = 1 AND a.src <> b.tgt")
def _(spark, d):
    e = _typed(spark, d)
    return _out(graphs.composed_edges(e, e, allen.full_dim(spark)))


@query("closure_before_chain", f"WITH RECURSIVE {CHAIN.format(k=5, rel=1)}, c AS (SELECT doc_id, src, tgt FROM chain UNION SELECT c.doc_id, c.src, h.tgt FROM c JOIN chain h ON c.doc_id = h.doc_id AND c.tgt = h.src) SELECT doc_id, src, tgt, 'before' AS relation FROM c UNION ALL SELECT doc_id, tgt, src, 'after' FROM c")
def _(spark, d):
    return _out(graphs.closure(views.chain_edges(spark, d, 5), allen.core_dim(spark)))


@query("closure_equal_subst", f"""WITH RECURSIVE {FIRST.format(k=4)}, w AS (SELECT a.doc_id, a.event_id AS e1, b.event_id AS e2, c.event_id AS e3, x.event_id AS e4 FROM ev a JOIN ev b USING (doc_id) JOIN ev c USING (doc_id) JOIN ev x USING (doc_id) WHERE a.ord = 1 AND b.ord = 2 AND c.ord = 3 AND x.ord = 4)
SELECT doc_id, e1 AS src, e2 AS tgt, 'equal' AS relation FROM w UNION ALL SELECT doc_id, e2, e1, 'equal' FROM w UNION ALL SELECT doc_id, e3, e4, 'equal' FROM w UNION ALL SELECT doc_id, e4, e3, 'equal' FROM w
UNION ALL SELECT doc_id, a, b, 'before' FROM w, (VALUES (1)) v(_) CROSS JOIN LATERAL (SELECT unnest([e1, e2]) AS a) CROSS JOIN LATERAL (SELECT unnest([e3, e4]) AS b)
UNION ALL SELECT doc_id, b, a, 'after' FROM w, (VALUES (1)) v(_) CROSS JOIN LATERAL (SELECT unnest([e1, e2]) AS a) CROSS JOIN LATERAL (SELECT unnest([e3, e4]) AS b)""")
def _(spark, d):
    """e1 equal e2, e2 before e3, e3 equal e4 for documents of four events."""
    e = views.chain_edges(spark, d, 4)
    whole = e.groupBy("doc_id").count().where("count = 3").select("doc_id")
    e = e.join(whole, "doc_id", "left_semi").withColumn("rel", F.when(F.col("ord") == 2, allen.ID["before"]).otherwise(allen.ID["equal"]))
    return _out(graphs.closure(e, allen.core_dim(spark)))


def _closure_sql(rounds: int) -> str:
    """Rounds of inversion and composition over the edges typed, until nothing more can come in graphs of six nodes."""
    parts = ["k0 AS MATERIALIZED (SELECT DISTINCT doc_id, src, tgt, rel FROM typed)", "one AS MATERIALIZED (SELECT r1, r2, log2(mask)::INT AS r3 FROM compose WHERE bit_count(mask::BIGINT) = 1)"]
    for i in range(rounds):
        parts.append(f"""k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION SELECT doc_id, tgt, src, CASE WHEN rel = 0 THEN 0 ELSE xor(rel - 1, 1) + 1 END FROM k{i}
  UNION SELECT a.doc_id, a.src, b.tgt, c.r3 FROM k{i} a JOIN k{i} b ON a.doc_id = b.doc_id AND a.tgt = b.src JOIN one c ON c.r1 = a.rel AND c.r2 = b.rel WHERE a.src <> b.tgt)""")
    return ", ".join(parts)


@query("closure_full", f"WITH {_TYPED}, {COMPOSE}, {_closure_sql(7)} SELECT doc_id, src, tgt, {sql_label('rel')} AS relation FROM k7")
def _(spark, d):
    return _out(graphs.closure(_typed(spark, d), allen.full_dim(spark)))


@query("closure_from_bounds", f"WITH {USER_PAIRS} SELECT doc_id, a AS src, b AS tgt, {sql_label(sql_rel())} AS relation FROM p UNION ALL SELECT doc_id, b, a, {sql_label(sql_rel('s2', 'e2', 's1', 'e1'))} FROM p")
def _(spark, d):
    """Fully bounded events: the times already give every pair, and the true compositions add nothing."""
    ev = views.user_type_events(spark, d)
    none = views.as_edges(views.pairs(ev).limit(0).select("doc_id", F.col("a").alias("src"), F.col("b").alias("tgt"), "rel", F.col("o1").alias("ord")))
    proper = ev.where("start_time < end_time")
    flat = ev.where("start_time >= end_time")
    full = _out(graphs.closure(none, allen.full_dim(spark), proper))
    p = views.pairs(ev).join(flat.select("doc_id", F.col("event_id").alias("x")), "doc_id").where("a = x OR b = x").dropDuplicates(["doc_id", "a", "b"])
    back = allen.relation(*[F.col(c) for c in ("s2", "e2", "s1", "e1")])
    rest = p.select("doc_id", F.col("a").alias("src"), F.col("b").alias("tgt"), label().alias("relation")).unionByName(p.select("doc_id", F.col("b").alias("src"), F.col("a").alias("tgt"), allen.label(back).alias("relation")))
    return full.unionByName(rest)


_REACH = f"WITH RECURSIVE {SEEDED}, c AS (SELECT doc_id, src AS origin, tgt AS node, 1 AS depth FROM edges WHERE src <> tgt UNION SELECT c.doc_id, origin, e.tgt, depth + 1 FROM c JOIN edges e ON c.doc_id = e.doc_id AND c.node = e.src WHERE depth < 5 AND e.tgt <> origin)"


def _reached(spark, d):
    e = views.seeded_edges(spark, d)
    return graphs.paths(e, e.select("doc_id", F.col("src").alias("origin")).distinct()).where("depth > 0")


@query("reachability", f"{_REACH} SELECT DISTINCT doc_id, origin, node FROM c")
def _(spark, d):
    return _reached(spark, d).select("doc_id", "origin", "node")


@query("shortest_path_len", f"{_REACH} SELECT doc_id, origin, node, min(depth)::BIGINT AS depth FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    return _reached(spark, d).select("doc_id", "origin", "node", F.col("depth").cast("long"))


def _asked(spark, d):
    ev = views.split_events(spark, d, 5)
    a = ev.where("ord = 1").select("doc_id", F.col("event_id").alias("src"))
    return a.join(ev.where("ord > 1").select("doc_id", F.col("event_id").alias("tgt")), "doc_id")


_ASKED = "q AS (SELECT a.doc_id, a.event_id AS src, b.event_id AS tgt FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.ord = 1 AND b.ord > 1)"


@query("relation_query", f"WITH {CHAIN.format(k=5, rel=1)}, {_ASKED} SELECT q.*, 'before' AS relation, h.src IS NULL AS is_inferred FROM q LEFT JOIN chain h USING (doc_id, src, tgt)")
def _(spark, d):
    e = graphs.closure(views.chain_edges(spark, d, 5), allen.core_dim(spark))
    return graphs.answer(_asked(spark, d), e, walk=False).select("doc_id", "src", "tgt", label().alias("relation"), "is_inferred")


@query("path_fallback", f"WITH {CHAIN.format(k=5, rel=1)}, {_ASKED} SELECT q.*, 'before' AS relation FROM q")
def _(spark, d):
    """No inference at all: the path of explicit edges answers."""
    return graphs.answer(_asked(spark, d), views.chain_edges(spark, d, 5)).select("doc_id", "src", "tgt", label().alias("relation"))


@query("explicit_first_pick", f"WITH {SEEDED} SELECT doc_id, src, tgt, {sql_label('arg_min(rel, ord)')} AS relation FROM edges GROUP BY 1, 2, 3")
def _(spark, d):
    return graphs.primary(views.seeded_edges(spark, d)).select("doc_id", "src", "tgt", label().alias("relation"))


@query("explanation_query", f"WITH {CHAIN.format(k=5, rel=1)} SELECT doc_id, tgt AS src, src AS tgt, 'Inverse of (' || src || ' before ' || tgt || ')' AS provenance FROM chain")
def _(spark, d):
    e = views.chain_edges(spark, d, 5)
    got = graphs.primary(graphs.closure(e, allen.core_dim(spark), transitive=False))
    return got.where("is_inferred").select("doc_id", "src", "tgt", "provenance")


@query("event_lookup", f"WITH {FIRST.format(k=5)}, n AS (SELECT DISTINCT doc_id, unnest([event_type, upper(event_type), event_id, 'nobody']) AS item FROM ev) SELECT n.doc_id, n.item, coalesce(min(a.event_id), max_by(b.event_id, b.ord), n.item) AS event_id FROM n LEFT JOIN ev a ON a.doc_id = n.doc_id AND a.event_id = n.item LEFT JOIN ev b ON b.doc_id = n.doc_id AND b.event_type = lower(n.item) GROUP BY 1, 2")
def _(spark, d):
    ev = views.split_events(spark, d, 5)
    names = ev.select("doc_id", F.explode(F.array("description", F.upper("description"), "event_id", F.lit("nobody"))).alias("item")).distinct()
    return graphs.resolve(names, ev)


def _ids(df, *more):
    return df.select("doc_id", F.array_join("event_ids", ",").alias("events"), *more)


@query("conflict_timestamp", f"WITH {_ORDER_SQL} SELECT doc_id, event_id::VARCHAR AS events FROM o WHERE s > e")
def _(spark, d):
    return _ids(graphs.timestamp_inversions(_order_events(spark, d).withColumn("event_id", F.col("event_id").cast("string"))))


@query("conflict_self_loop", f"WITH {SEEDED} SELECT doc_id, src AS events, {sql_label('rel')} AS relation FROM edges WHERE src = tgt AND rel IN (1, 2, 3)")
def _(spark, d):
    return _ids(graphs.self_loops(views.seeded_edges(spark, d)), label().alias("relation"))


_DIS = ", ".join(f"({allen.ID[a]}, {allen.ID[b]})" for a, b in allen.DISJOINT)


@query("conflict_disjoint", f"WITH {SEEDED} SELECT DISTINCT a.doc_id, a.src || ',' || a.tgt AS events, {sql_label('a.rel')} AS relation, {sql_label('b.rel')} AS other FROM edges a JOIN edges b USING (doc_id, src, tgt) JOIN (VALUES {_DIS}) v(x, y) ON a.rel = x AND b.rel = y WHERE a.src <> a.tgt")
def _(spark, d):
    return _ids(graphs.disjoint_relations(views.seeded_edges(spark, d)), label().alias("relation"), label("rel2").alias("other"))


@query("conflict_mutual", f"WITH {SEEDED} SELECT a.doc_id, a.src || ',' || a.tgt AS events FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.src = b.tgt AND a.tgt = b.src WHERE a.rel = 1 AND b.rel = 1 AND a.src <> a.tgt")
def _(spark, d):
    return _ids(graphs.mutual_before(views.seeded_edges(spark, d)))


@query("conflict_cycle_nodes", f"WITH RECURSIVE {SEEDED}, c AS (SELECT doc_id, src, tgt FROM edges WHERE rel IN (1, 3) UNION SELECT c.doc_id, c.src, e.tgt FROM c JOIN edges e ON c.doc_id = e.doc_id AND c.tgt = e.src WHERE e.rel IN (1, 3)) SELECT doc_id, src AS node FROM c WHERE src = tgt")
def _(spark, d):
    return graphs.cycle_nodes(views.seeded_edges(spark, d))


@query("conflict_cycle_path", f"WITH {SEEDED} SELECT doc_id, e1 || ',' || e2 || ',' || e3 || ',' || e4 || ',' || e5 || ',' || e1 AS events FROM w WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 AND e5 IS NOT NULL UNION ALL SELECT doc_id, e1 || ',' || e2 || ',' || e1 FROM w WHERE doc_id % 5 = 1 AND doc_id % 7 <> 0 AND e2 IS NOT NULL UNION ALL SELECT doc_id, e3 || ',' || e3 FROM w WHERE doc_id % 5 = 2 AND doc_id % 7 <> 0 AND e3 IS NOT NULL")
def _(spark, d):
    return _ids(graphs.cycle_paths(views.seeded_edges(spark, d)))


@query("conflict_mismatch", f"WITH {CHAIN.format(k=6, rel=1)}, x AS (SELECT doc_id, event_id, ts AS s, ts - to_minutes(floor(value)::BIGINT * 600) AS e FROM ev) SELECT c.doc_id, c.tgt || ',' || c.src AS events FROM chain c JOIN x a ON a.doc_id = c.doc_id AND a.event_id = c.tgt JOIN x b ON b.doc_id = c.doc_id AND b.event_id = c.src WHERE a.s >= b.e")
def _(spark, d):
    """Chains turned around, so that edges claim before where the times say after."""
    back = F.floor("value").cast("long") * 36000000000
    ev = views.split_events(spark, d, 6).select("doc_id", "event_id", F.col("ts").alias("start_time"), graphs.from_microseconds(graphs.microseconds(F.col("ts")) - back).alias("end_time"))
    e = views.chain_edges(spark, d, 6).withColumns({"src": F.col("tgt"), "tgt": F.col("src")})
    return _ids(graphs.mismatches(e, ev))


@query("conflict_report", f"""WITH RECURSIVE {SEEDED}, x AS (
  SELECT doc_id, 'SELF_LOOP_CONFLICT' AS conflict_type FROM edges WHERE src = tgt AND rel IN (1, 2, 3)
  UNION ALL SELECT doc_id, 'DISJOINT_RELATIONS' FROM (SELECT DISTINCT a.doc_id, a.src, a.tgt, a.rel, b.rel AS r2 FROM edges a JOIN edges b USING (doc_id, src, tgt) JOIN (VALUES {_DIS}) v(x, y) ON a.rel = x AND b.rel = y WHERE a.src <> a.tgt)
  UNION ALL SELECT a.doc_id, 'MUTUAL_BEFORE_CONFLICT' FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.src = b.tgt AND a.tgt = b.src WHERE a.rel = 1 AND b.rel = 1 AND a.src <> a.tgt
  UNION ALL SELECT doc_id, 'STRICT_ORDER_CYCLE' FROM w WHERE doc_id % 7 <> 0 AND ((doc_id % 5 = 0 AND e5 IS NOT NULL) OR (doc_id % 5 = 1 AND e2 IS NOT NULL) OR (doc_id % 5 = 2 AND e3 IS NOT NULL)))
SELECT conflict_type, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM x GROUP BY 1""")
def _(spark, d):
    e = views.seeded_edges(spark, d)
    ev = views.split_events(spark, d, 5).select("doc_id", "event_id", F.col("ts").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"))
    return graphs.conflicts(e, ev).groupBy("conflict_type").agg(_n(), F.countDistinct("doc_id").alias("n_documents"))


@query("direct_contradictions", f"WITH {SEEDED} SELECT doc_id, 'self_loop_conflict' AS kind, src, tgt FROM edges WHERE src = tgt AND rel IN (1, 2) UNION ALL SELECT doc_id, 'direct_relation_conflict', src, tgt FROM edges WHERE rel IN (1, 2) GROUP BY doc_id, src, tgt HAVING count(DISTINCT rel) = 2")
def _(spark, d):
    return graphs.direct_contradictions(views.seeded_edges(spark, d))


@query("sql_functions", f"WITH {USER_PAIRS} SELECT {sql_label(sql_rel())} AS relation, {sql_label(sql_rel('s2', 'e2', 's1', 'e1'))} AS inverse, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, d):
    """The algebra through the session's SQL functions."""
    allen.register(spark)
    rel = F.expr("allen_relation(s1, e1, s2, e2)")
    got = views.pairs(views.user_type_events(spark, d)).select(rel.alias("r"))
    return got.groupBy(F.expr("allen_label(r)").alias("relation"), F.expr("allen_label(allen_inverse(r))").alias("inverse")).agg(_n())
