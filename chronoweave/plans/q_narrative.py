"""Queries of narrative graphs, datasets and statistics, and their SQL.

A story is eight events of a user in a row, so that every event is in one: threads are event types, intervals run for
`value` minutes from the event's minute. Gold edges go to the next two events; predictions drop, turn round and relabel
some of them by their number. A quarter of the texts names the event's thread first, a quarter late, a quarter not at all,
and a quarter names the thread of clicks.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import allen
from chronoweave.operators import narrative, statistics, stories

from . import views
from .q_graph import COMPOSE, N2, REPS, label, sql_label, sql_rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


K = 8


def _events(spark, d):
    ev = views.split_events(spark, d, K)
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000)
    name, at, kind = F.initcap("description"), F.concat(F.lit(" at "), F.col("ord").cast("string")), (F.col("ord") + F.col("doc_id")) % 4
    text = F.when(kind == 0, F.concat(F.lit("Later on that same day came "), name, at)).when(kind == 1, F.concat(F.lit("Nobody was there"), at)).when(kind == 2, F.concat(F.lit("Click"), at)).otherwise(F.concat(name, at))
    return ev.select(F.col("doc_id").alias("story_id"), F.concat(F.lit("s"), F.col("ord").cast("string")).alias("id"), "ord", F.col("description").alias("thread_id"), minute.alias("start"), (minute + F.floor("value").cast("long") + 1).alias("end"), text.alias("text"))


def _links(events):
    a = events.select("story_id", F.col("id").alias("node_i"), F.col("ord").alias("_o"))
    b = events.select("story_id", F.col("id").alias("node_j"), F.col("ord").alias("_p"))
    return a.join(b, "story_id").where("_p - _o BETWEEN 1 AND 2").select("story_id", "node_i", "node_j", (F.col("_o") * 10 + F.col("_p")).alias("ord"))


def _gold(spark, d):
    ev = _events(spark, d)
    return stories.gold_edges(_links(ev), ev)


def _predicted(gold):
    """Every fifth edge is missing, every third is turned round, every seventh says before."""
    n = F.col("ord") + F.col("story_id")
    rel = F.when(n % 7 == 0, allen.ID["before"]).otherwise(F.col("rel"))
    turn = n % 3 == 0
    rows = gold.where(n % 5 != 0).withColumn("rel", rel)
    return rows.select("story_id", F.when(turn, F.col("node_j")).otherwise(F.col("node_i")).alias("node_i"), F.when(turn, F.col("node_i")).otherwise(F.col("node_j")).alias("node_j"), F.when(turn, allen.inverse(F.col("rel"))).otherwise(F.col("rel")).alias("rel"), "ord")


def _order(events):
    """Positions of all events but each story's fourth."""
    return events.where("ord <> 4").select("story_id", "id", F.col("ord").alias("position"))


_EV = """ev AS (SELECT story_id, 's' || ord AS id, ord, thread_id, (epoch_us(date_trunc('minute', ts)) // 60000000) AS s, (epoch_us(date_trunc('minute', ts)) // 60000000) + floor(value)::BIGINT + 1 AS e, upper(thread_id[1]) || thread_id[2:] AS name, (ord + story_id) % 4 AS kind FROM
  (SELECT user_id * 100000 + nth // 8 AS story_id, thread_id, ts, value, nth % 8 + 1 AS ord FROM (SELECT user_id, event_type AS thread_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events)))"""
_TEXT = "CASE kind WHEN 0 THEN 'Later on that same day came ' || name WHEN 1 THEN 'Nobody was there' WHEN 2 THEN 'Click' ELSE name END || ' at ' || ord"
_OPENS = "(kind = 3 OR (kind = 2 AND thread_id = 'click'))"
_GOLD = f"{_EV}, gold AS (SELECT a.story_id, a.id AS node_i, b.id AS node_j, a.ord * 10 + b.ord AS ord, a.ord AS oi, b.ord AS oj, {sql_rel('a.s', 'a.e', 'b.s', 'b.e')} AS rel FROM ev a JOIN ev b ON a.story_id = b.story_id AND b.ord - a.ord BETWEEN 1 AND 2)"
_DIST = f"{REPS}, dist AS (SELECT a.rel AS r1, b.rel AS r2, greatest(0.0, 1.0 - ((sign(a.s1 - 2) <> sign(b.s1 - 2))::INT + (sign(a.s1 - 5) <> sign(b.s1 - 5))::INT + (sign(a.e1 - 2) <> sign(b.e1 - 2))::INT + (sign(a.e1 - 5) <> sign(b.e1 - 5))::INT) / 6.0) AS score FROM reps a, reps b)"
_SCORED = f"""{_GOLD}, {_DIST}, pr AS (SELECT *, CASE WHEN (ord + story_id) % 5 = 0 THEN CASE WHEN oi <> 4 AND oj <> 4 THEN 1 END WHEN (ord + story_id) % 7 = 0 THEN 1 ELSE rel END AS predicted,
  CASE WHEN (ord + story_id) % 5 = 0 THEN CASE WHEN oi <> 4 AND oj <> 4 THEN 'derived-from-order' ELSE 'missing' END WHEN (ord + story_id) % 3 = 0 THEN 'explicit-reversed' ELSE 'explicit' END AS predicted_from FROM gold),
sc AS (SELECT pr.*, coalesce(score, 0.0)::DOUBLE AS score FROM pr LEFT JOIN dist ON r1 = rel AND r2 = predicted)"""


def _scored(spark, d):
    ev = _events(spark, d)
    gold = stories.gold_edges(_links(ev), ev)
    return narrative.scored_edges(gold, _predicted(gold), _order(ev), allen.distance_dim(spark))


@query("gold_edges", f"WITH {_GOLD} SELECT story_id, node_i, node_j, {sql_label('rel', N2)} AS relation FROM gold")
def _(spark, d):
    return _gold(spark, d).select("story_id", "node_i", "node_j", label("rel", allen.RELATIONS).alias("relation"))


@query("scored_edges", f"WITH {_SCORED} SELECT story_id, node_i, node_j, {sql_label('rel', N2)} AS gold, CASE WHEN predicted IS NOT NULL THEN {sql_label('predicted', N2)} END AS predicted, predicted_from, round(score, 9) AS score FROM sc")
def _(spark, d):
    return _scored(spark, d).select("story_id", "node_i", "node_j", label("gold", allen.RELATIONS).alias("gold"), label("predicted", allen.RELATIONS).alias("predicted"), "predicted_from", F.round("score", 9).alias("score"))


@query("relation_score", f"WITH {_SCORED} SELECT st.story_id, round(coalesce(avg(score), 1.0), 9) AS relation_score FROM (SELECT DISTINCT story_id FROM ev) st LEFT JOIN sc USING (story_id) GROUP BY 1")
def _(spark, d):
    return narrative.relation_score(_events(spark, d).select("story_id").distinct(), _scored(spark, d)).select("story_id", F.round("relation_score", 9).alias("relation_score"))


@query("order_derived_edges", f"WITH {_GOLD} SELECT story_id, node_i, node_j, 'before' AS relation FROM gold WHERE oi <> 4 AND oj <> 4")
def _(spark, d):
    ev = _events(spark, d)
    return narrative.order_edges(_links(ev), _order(ev)).select("story_id", "node_i", "node_j", label("rel", allen.RELATIONS).alias("relation"))


def _threads_predicted(ev):
    """Threads under other names; every sixth event is put into another one, every eighth is missing."""
    name = F.when((F.col("ord") + F.col("story_id")) % 6 == 0, "T_other").otherwise(F.concat(F.lit("T_"), F.upper("thread_id")))
    return ev.where((F.col("ord") + F.col("story_id")) % 8 != 0).select("story_id", "id", name.alias("thread_id"))


_PT = f"{_EV}, pt AS (SELECT story_id, id, CASE WHEN (ord + story_id) % 6 = 0 THEN 'T_other' ELSE 'T_' || upper(thread_id) END AS label FROM ev WHERE (ord + story_id) % 8 <> 0), ct AS (SELECT ev.story_id, thread_id AS g, label AS p, count(*) AS n FROM ev JOIN pt USING (story_id, id) GROUP BY 1, 2, 3)"


@query("thread_contingency", f"WITH {_PT} SELECT story_id, g AS gold_label, p AS predicted_label, n FROM ct")
def _(spark, d):
    ev = _events(spark, d)
    return narrative.contingency(ev, _threads_predicted(ev))


#: Best one-to-one total w of the common events ct (story_id, g, p, n) by trying every partial mapping.
_BEST = """gl AS (SELECT story_id, g, row_number() OVER (PARTITION BY story_id ORDER BY g) AS i FROM (SELECT DISTINCT story_id, g FROM ct)),
w AS (SELECT story_id, 0::BIGINT AS i, []::VARCHAR[] AS used, 0::BIGINT AS n FROM (SELECT DISTINCT story_id FROM gl)
  UNION ALL SELECT w.story_id, w.i + 1, CASE WHEN ct.p IS NULL THEN used ELSE list_append(used, ct.p) END, w.n + coalesce(ct.n, 0) FROM w JOIN gl ON gl.story_id = w.story_id AND gl.i = w.i + 1
  JOIN (SELECT story_id, g, p, n FROM ct UNION ALL SELECT story_id, g, NULL, 0 FROM gl) ct ON ct.story_id = w.story_id AND ct.g = gl.g AND (ct.p IS NULL OR NOT list_contains(used, ct.p))),
acc AS (SELECT e.story_id, coalesce(max(w.n), 0) / max(e.c) AS thread_accuracy FROM (SELECT story_id, count(*) AS c FROM ev GROUP BY 1) e LEFT JOIN w USING (story_id) GROUP BY 1)"""


@query("thread_accuracy", f"WITH RECURSIVE {_PT}, {_BEST} SELECT story_id, round(thread_accuracy, 9) AS thread_accuracy FROM acc")
def _(spark, d):
    ev = _events(spark, d)
    p = _threads_predicted(ev)
    got = narrative.thread_accuracy(ev, p, narrative.best_mapping(narrative.contingency(ev, p)))
    return got.select("story_id", F.round("thread_accuracy", 9).alias("thread_accuracy"))


def _pairs(spark, d):
    """(gold pairs, proposed pairs): neighbours of two threads; every third gold pair is missed, others are made up."""
    ev = _events(spark, d)
    e = stories._ends(_links(ev), ev, "thread_id").where("thread_id_i <> thread_id_j")
    n = F.col("ord") + F.col("story_id")
    pair = lambda df: df.select("story_id", F.col("node_i").alias("a"), F.col("node_j").alias("b"))
    made = e.where((n % 3 != 0) & (n % 4 != 1)).select("story_id", F.col("node_j").alias("a"), F.col("node_i").alias("b"))
    return ev, pair(e.where(n % 4 < 2)), made


_PAIRS = f"""{_GOLD}, x AS (SELECT g.story_id, least(node_i, node_j) AS a, greatest(node_i, node_j) AS b, g.ord + g.story_id AS n FROM gold g JOIN ev p ON p.story_id = g.story_id AND p.id = node_i JOIN ev q ON q.story_id = g.story_id AND q.id = node_j WHERE p.thread_id <> q.thread_id),
gp AS (SELECT story_id, a, b FROM x WHERE n % 4 < 2), pp AS (SELECT story_id, a, b FROM x WHERE n % 3 <> 0 AND n % 4 <> 1), st AS (SELECT DISTINCT story_id FROM ev),
k AS (SELECT st.story_id, (SELECT count(*) FROM gp WHERE gp.story_id = st.story_id) AS g, (SELECT count(*) FROM pp WHERE pp.story_id = st.story_id) AS p, (SELECT count(*) FROM gp JOIN pp USING (story_id, a, b) WHERE gp.story_id = st.story_id) AS h FROM st),
f AS (SELECT story_id, g, p, CASE WHEN g = 0 AND p = 0 THEN 1.0 WHEN g = 0 OR p = 0 THEN 0.0 ELSE h / p END AS pr, CASE WHEN g = 0 AND p = 0 THEN 1.0 WHEN g = 0 OR p = 0 THEN 0.0 ELSE h / g END AS rc FROM k)"""


@query("conv_f1", f"WITH {_PAIRS} SELECT story_id, g AS n_gold, p AS n_predicted, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 9) AS f1 FROM f")
def _(spark, d):
    ev, gold, made = _pairs(spark, d)
    return _rounded(narrative.set_scores(gold, made, ev.select("story_id").distinct()), "precision", "recall", "f1")


def _rounded(df, *cols):
    return df.select(*[F.round(c, 9).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("conv_pooled_f1", f"WITH {_PAIRS}, t AS (SELECT sum(g)::BIGINT AS g, sum(p)::BIGINT AS p, (SELECT count(*) FROM gp JOIN pp USING (story_id, a, b)) AS h FROM k) SELECT g AS n_gold, p AS n_predicted, round(h / p, 9) AS precision, round(h / g, 9) AS recall, round(2 * (h / p) * (h / g) / (h / p + h / g), 9) AS f1 FROM t")
def _(spark, d):
    _, gold, made = _pairs(spark, d)
    return _rounded(narrative.set_scores(gold, made), "precision", "recall", "f1")


_POOL = f"""{_EV}, fr AS (SELECT story_id, min(s) AS fs, max(e) AS fe FROM ev GROUP BY 1),
pool AS (SELECT a.story_id, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM ev a JOIN ev b ON a.story_id = b.story_id AND a.ord < b.ord AND a.thread_id <> b.thread_id JOIN fr ON fr.story_id = a.story_id
  WHERE (a.s = b.s OR a.s = b.e OR a.e = b.s OR a.e = b.e) AND NOT (a.s = fs AND b.s = fs) AND NOT (a.e = fe AND b.e = fe))"""


def _ship_stories(spark, d):
    """Customers as stories: orders are events with days of shipment, threads are priorities."""
    o = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    l = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    got = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return got.select(F.col("o_custkey").alias("story_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("thread_id"), day("s").alias("start"), (day("e") + 1).alias("end"))


_SHIP = """ev AS (SELECT o_custkey AS story_id, o_orderkey::VARCHAR AS id, o_orderkey AS ord, o_orderpriority AS thread_id, date_diff('day', DATE '1970-01-01', min(l_shipdate)::DATE) AS s, date_diff('day', DATE '1970-01-01', max(l_shipdate)::DATE) + 1 AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4)"""


@query("boundary_pool", f"WITH {_POOL.replace(_EV, _SHIP)} SELECT * FROM pool")
def _(spark, d):
    return stories.convergence_pool(_ship_stories(spark, d))


@query("conv_closure_aware", f"""WITH {_PAIRS}, {_POOL.replace(_EV + ', ', '')}, c AS (SELECT st.story_id, (SELECT count(*) FROM gp WHERE gp.story_id = st.story_id) AS ns, (SELECT count(*) FROM pp WHERE pp.story_id = st.story_id) AS np, (SELECT count(*) FROM pool WHERE pool.story_id = st.story_id) AS nv,
  (SELECT count(*) FROM gp JOIN pp USING (story_id, a, b) WHERE gp.story_id = st.story_id) AS hits, (SELECT count(*) FROM pp JOIN (SELECT * FROM gp UNION SELECT * FROM pool) v USING (story_id, a, b) WHERE pp.story_id = st.story_id) AS valid FROM st)
SELECT story_id, round(CASE WHEN np > 0 THEN valid / np WHEN ns = 0 THEN 1.0 ELSE 0.0 END, 9) AS precision_vs_pool, round(CASE WHEN ns > 0 THEN hits / ns ELSE 1.0 END, 9) AS recall_salient, nv > 0 AS pool_available, np AS n_proposed, ns AS n_salient, nv AS n_pool FROM c""")
def _(spark, d):
    ev, gold, made = _pairs(spark, d)
    return _rounded(narrative.closure_aware(gold, made, stories.convergence_pool(ev), ev.select("story_id").distinct()), "precision_vs_pool", "recall_salient")


@query("harmonic_core", f"WITH {_SCORED}, r AS (SELECT story_id, avg(score) AS a, avg((predicted_from = 'explicit')::INT) AS b FROM sc GROUP BY 1) SELECT story_id, round(CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE 2 / (1 / a + 1 / b) END, 9) AS core FROM r")
def _(spark, d):
    r = _scored(spark, d).groupBy("story_id").agg(F.avg("score").alias("a"), F.avg((F.col("predicted_from") == "explicit").cast("int")).alias("b"))
    return r.select("story_id", F.round(narrative.harmonic(F.array("a", "b")), 9).alias("core"))


@query("memorization_gap", f"WITH {_SCORED}, r AS (SELECT story_id, avg(score) AS a, avg(score) FILTER (ord % 2 = 0) AS b FROM sc GROUP BY 1) SELECT story_id, round(a - b, 9) AS score_gap FROM r WHERE b IS NOT NULL")
def _(spark, d):
    s = _scored(spark, d)
    mean = lambda df: df.groupBy("story_id").agg(F.avg("score").alias("score"))
    return _rounded(narrative.gap(mean(s), mean(s.where("ord % 2 = 0")), ["score"]), "score_gap")


def _record_sql(rel: str, pool: str) -> str:
    """All scores of a story: rel gives story_id, relation_score; pool story_id, a, b."""
    return f"""rs AS ({rel}), pool AS ({pool}), c AS (SELECT st.story_id, (SELECT count(*) FROM gp WHERE gp.story_id = st.story_id) AS ns, (SELECT count(*) FROM pp WHERE pp.story_id = st.story_id) AS np, (SELECT count(*) FROM pool WHERE pool.story_id = st.story_id) AS nv,
  (SELECT count(*) FROM gp JOIN pp USING (story_id, a, b) WHERE gp.story_id = st.story_id) AS hits, (SELECT count(*) FROM pp JOIN (SELECT * FROM gp UNION SELECT * FROM pool) v USING (story_id, a, b) WHERE pp.story_id = st.story_id) AS valid FROM st),
al AS (SELECT story_id, relation_score, thread_accuracy, pr AS convergence_precision, rc AS convergence_recall, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS convergence_f1,
  CASE WHEN np > 0 THEN valid / np WHEN ns = 0 THEN 1.0 ELSE 0.0 END AS precision_vs_pool, CASE WHEN ns > 0 THEN hits / ns ELSE 1.0 END AS recall_salient, nv > 0 AS pool_available, np AS n_proposed, ns AS n_salient, nv AS n_pool FROM rs JOIN acc USING (story_id) JOIN f USING (story_id) JOIN c USING (story_id))
SELECT * REPLACE ({', '.join(f'round({x}, 9) AS {x}' for x in _SCORES)}), round(CASE WHEN least(relation_score, thread_accuracy) <= 0 THEN 0 ELSE 2 / (1 / relation_score + 1 / thread_accuracy) END, 9)::DOUBLE AS awt_core,
  round(CASE WHEN least(relation_score, thread_accuracy, convergence_f1) <= 0 THEN 0 ELSE 3 / (1 / relation_score + 1 / thread_accuracy + 1 / convergence_f1) END, 9)::DOUBLE AS awt_f1 FROM al"""


_SCORES = ("relation_score", "thread_accuracy", "convergence_precision", "convergence_recall", "convergence_f1", "precision_vs_pool", "recall_salient")
#: Everything that a record of scores needs; the parts share ev and gold.
RECORD = f"WITH RECURSIVE {_SCORED}, {_PT.replace(_EV + ', ', '')}, {_BEST}, {_PAIRS.replace(_GOLD + ', ', '')}, {_POOL.replace(_EV + ', ', '').replace('pool AS', 'true_pool AS')}, "


def record(df):
    return _rounded(df, *_SCORES, "awt_core", "awt_f1")


@query("score_record", RECORD + _record_sql("SELECT st.story_id, coalesce(avg(score), 1.0) AS relation_score FROM st LEFT JOIN sc USING (story_id) GROUP BY 1", "SELECT * FROM true_pool"))
def _(spark, d):
    ev, gold_pairs, made = _pairs(spark, d)
    gold = stories.gold_edges(_links(ev), ev)
    return record(narrative.score_record(ev, _threads_predicted(ev), gold, _predicted(gold), _order(ev), gold_pairs, made, stories.convergence_pool(ev)))


def _triangles(spark, d):
    """Gold edges of each story with the first one turned to after."""
    return _gold(spark, d).withColumn("rel", F.when(F.col("ord") == 12, allen.ID["after"]).otherwise(F.col("rel")))


_TRI = f"{_GOLD}, {COMPOSE}, tri AS (SELECT story_id, node_i, node_j, ord, CASE WHEN ord = 12 THEN 2 ELSE rel END AS rel FROM gold), both2 AS (SELECT story_id, node_i AS x, node_j AS y, rel AS r FROM tri UNION ALL SELECT story_id, node_j, node_i, CASE WHEN rel = 0 THEN 0 ELSE xor(rel - 1, 1) + 1 END FROM tri), vt AS (SELECT t.story_id, t.node_i, t.node_j, t.ord, t.rel, bit_and(c.mask) AS mask, count(*) AS n FROM tri t JOIN both2 a ON a.story_id = t.story_id AND a.x = t.node_i JOIN both2 b ON b.story_id = t.story_id AND b.x = a.y AND b.y = t.node_j JOIN compose c ON c.r1 = a.r AND c.r2 = b.r WHERE a.y <> t.node_i AND a.y <> t.node_j GROUP BY ALL)"


@query("repair_votes", f"WITH {_TRI} SELECT story_id, node_i, node_j, mask::BIGINT AS mask, n FROM vt")
def _(spark, d):
    return narrative.votes(_triangles(spark, d), allen.composition_dim(spark)).select("story_id", "node_i", "node_j", F.col("mask").cast("long"), "n")


_DECIDED = f"""{_TRI}, {_DIST}, bad AS (SELECT * FROM vt WHERE (mask & (1 << rel)) = 0), o AS (SELECT bad.*, r2, score FROM bad JOIN dist ON r1 = rel AND (mask & (1 << r2)) <> 0),
dec AS (SELECT bad.*, CASE WHEN bad.mask <> 0 AND bad.n >= 2 THEN (SELECT arg_min(r2, (1 - score) * 100 + r2) FROM o WHERE o.story_id = bad.story_id AND o.ord = bad.ord) END AS to_rel, CASE WHEN bad.mask = 0 THEN 'witnesses_disagree' WHEN bad.n < 2 THEN 'too_few_witnesses' ELSE 'repaired' END AS reason FROM bad)"""


@query("repair_decisions", f"WITH {_DECIDED} SELECT story_id, node_i, node_j, {sql_label('rel', N2)} AS from_relation, CASE WHEN to_rel IS NOT NULL THEN {sql_label('to_rel', N2)} END AS to_relation, reason FROM dec")
def _(spark, d):
    got = narrative.decide(narrative.votes(_triangles(spark, d), allen.composition_dim(spark)), allen.distance_dim(spark))
    return got.select("story_id", "node_i", "node_j", label("rel", allen.RELATIONS).alias("from_relation"), label("to_rel", allen.RELATIONS).alias("to_relation"), "reason")


@query("repair_pass", f"WITH {_DECIDED} SELECT t.story_id, t.node_i, t.node_j, {sql_label('coalesce(dec.to_rel, t.rel)', N2)} AS relation FROM tri t LEFT JOIN dec USING (story_id, ord)")
def _(spark, d):
    """The first pass; tests look at more of them."""
    edges, _ = narrative.repair(_triangles(spark, d), max_passes=1)
    return edges.select("story_id", "node_i", "node_j", label("rel", allen.RELATIONS).alias("relation"))


def _within(ev):
    """Edges between all events of one thread as if each lasted a minute, so that starts alone fix its order."""
    a = ev.select("story_id", "thread_id", F.col("id").alias("node_i"), F.col("ord").alias("_o"))
    b = ev.select("story_id", "thread_id", F.col("id").alias("node_j"), F.col("ord").alias("_p"))
    links = a.join(b, ["story_id", "thread_id"]).where("_o < _p").select("story_id", "node_i", "node_j", (F.col("_o") * 10 + F.col("_p")).alias("ord"))
    return stories.gold_edges(links, ev.withColumn("end", F.col("start") + 1))


def _nested(spark, d):
    ev = _events(spark, d)
    gold = stories.gold_edges(_links(ev), ev)
    e = stories._ends(_links(ev), ev, "thread_id").where("thread_id_i <> thread_id_j")
    bad = _links(ev).where("ord % 7 = 0").select("story_id", F.col("node_i").alias("a"), F.lit("nobody").alias("b"), (F.col("ord") + 1000).alias("ord"))
    dup = e.where("ord % 2 = 0").select("story_id", F.col("node_j").alias("a"), F.col("node_i").alias("b"), (F.col("ord") + 500).alias("ord"))
    cand = e.select("story_id", F.col("node_i").alias("a"), F.col("node_j").alias("b"), "ord").unionByName(bad).unionByName(dup)
    same = stories._ends(_links(ev), ev, "thread_id").where("thread_id_i = thread_id_j").select("story_id", F.col("node_i").alias("a"), F.col("node_j").alias("b"), (F.col("ord") + 2000).alias("ord"))
    return narrative.as_stories(ev.select("story_id", "id", "thread_id"), gold.unionByName(_within(ev)), cand.unionByName(same))


@query("candidate_filter_log", f"""WITH {_GOLD}, x AS (SELECT g.*, p.thread_id AS ti, q.thread_id AS tj FROM gold g JOIN ev p ON p.story_id = g.story_id AND p.id = node_i JOIN ev q ON q.story_id = g.story_id AND q.id = node_j)
SELECT 'unknown_or_repeated_node' AS reason, count(*) AS n FROM x WHERE ord % 7 = 0 UNION ALL SELECT 'duplicate', count(*) FROM x WHERE ti <> tj AND ord % 2 = 0 UNION ALL SELECT 'same_thread', count(*) FROM x WHERE ti = tj""")
def _(spark, d):
    log = narrative.finish(_nested(spark, d)).select(F.explode("log").alias("l"))
    return log.where(F.col("l.reason").isin("unknown_or_repeated_node", "duplicate", "same_thread")).groupBy(F.col("l.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Place of an event in its thread: by start; equal ones keep the order of their ids.
_PLACED = "tp AS (SELECT *, row_number() OVER (PARTITION BY story_id, thread_id ORDER BY s, ord) AS place FROM ev)"


@query("topo_order", f"WITH {_EV}, {_PLACED} SELECT story_id, thread_id, string_agg(id, ',' ORDER BY place) AS members, count(*) AS n FROM tp GROUP BY 1, 2")
def _(spark, d):
    got = narrative.finish(_nested(spark, d)).select("story_id", F.explode("thread_orders").alias("thread_id", "o"))
    return got.select("story_id", "thread_id", F.array_join("o", ",").alias("members"), F.size("o").cast("long").alias("n"))


@query("align_order", f"""WITH {_EV}, {_PLACED}, an AS (SELECT x.story_id, x.thread_id AS t1, x.place AS p1, y.thread_id AS t2, y.place AS p2 FROM tp x JOIN tp y ON x.story_id = y.story_id AND x.ord = 1
    AND y.ord = (SELECT min(z.ord) FROM tp z WHERE z.story_id = x.story_id AND z.thread_id <> x.thread_id)),
  q AS (SELECT tp.*, CASE WHEN tp.thread_id = t1 AND place <= p1 THEN 0 WHEN tp.thread_id = t2 AND place <= p2 THEN 1 ELSE 2 END AS part FROM tp LEFT JOIN an USING (story_id))
  SELECT story_id, string_agg(id, ',' ORDER BY part, thread_id, place) AS members FROM q GROUP BY 1""")
def _(spark, d):
    """One anchor a story: its first event and the first one of another thread."""
    ev = _events(spark, d)
    first = ev.where("ord = 1").select("story_id", F.col("id").alias("a"), F.col("thread_id").alias("_t"))
    other = ev.join(first, "story_id").where("thread_id <> _t").groupBy("story_id", "a").agg(F.min_by("id", "ord").alias("b"), F.min("ord").alias("ord"))
    nested = narrative.as_stories(ev.select("story_id", "id", "thread_id"), _within(ev), other)
    return narrative.finish(nested).select("story_id", F.array_join("global_order", ",").alias("members"))


@query("lis_verify", f"""WITH RECURSIVE {_GOLD}, {_PLACED}, x AS (SELECT g.story_id, g.ord, p.thread_id AS ti, q.thread_id AS tj, p.place AS pi, q.place AS pj FROM gold g JOIN tp p ON p.story_id = g.story_id AND p.id = node_i JOIN tp q ON q.story_id = g.story_id AND q.id = node_j WHERE p.thread_id <> q.thread_id),
  y AS (SELECT *, least(ti, tj) || '/' || greatest(ti, tj) AS pair, first_value(ti) OVER (PARTITION BY story_id, least(ti, tj), greatest(ti, tj) ORDER BY ord) AS lead FROM x),
  z AS (SELECT story_id, pair, row_number() OVER (PARTITION BY story_id, pair ORDER BY CASE WHEN ti = lead THEN pi ELSE pj END, ord) AS i, CASE WHEN ti = lead THEN pj ELSE pi END AS v FROM y),
  l AS (SELECT story_id, pair, i, v, 1 AS n FROM z UNION SELECT z.story_id, z.pair, z.i, z.v, l.n + 1 FROM l JOIN z ON z.story_id = l.story_id AND z.pair = l.pair AND z.i > l.i AND z.v > l.v)
  SELECT story_id, sum(n)::BIGINT AS n FROM (SELECT story_id, pair, max(n) AS n FROM l GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    """How many pairs of each story keep one order in both threads."""
    return narrative.finish(_nested(spark, d)).select("story_id", F.size("convergence").cast("long").alias("n")).where("n > 0")


def _groups(spark, d):
    ev = _events(spark, d)
    g = ev.groupBy("story_id", "thread_id").agg(F.array_sort(F.collect_list("id")).alias("members"), F.min("ord").alias("ord"))
    return g.where(F.size("members") >= 2)


@query("group_expand", f"WITH {_EV} SELECT a.story_id, a.id AS a, b.id AS b FROM ev a JOIN ev b ON a.story_id = b.story_id AND a.thread_id = b.thread_id AND a.id < b.id")
def _(spark, d):
    return narrative.expand_groups(_groups(spark, d)).select("story_id", "a", "b")


@query("group_union", f"WITH {_EV}, g AS (SELECT story_id, thread_id, string_agg(id, '|' ORDER BY id) AS m, count(*) AS n FROM ev GROUP BY 1, 2) SELECT story_id, m AS members FROM g WHERE n >= 2")
def _(spark, d):
    g = _groups(spark, d).select("story_id", "ord", "members")
    again = g.select("story_id", "ord", F.reverse("members").alias("members"))
    return narrative.merge_groups(g, again).select("story_id", F.array_join(F.array_sort("members"), "|").alias("members"))


@query("relation_coverage", f"WITH {_GOLD}, t AS (SELECT count(*) AS t FROM gold) SELECT name AS relation, coalesce(c, 0) AS n, round(coalesce(c, 0) / t, 9) AS share FROM (SELECT unnest([{N2}]) AS name, unnest(range(13)) AS r) LEFT JOIN (SELECT rel, count(*) AS c FROM gold GROUP BY 1) ON rel = r, t")
def _(spark, d):
    return _rounded(stories.coverage(_gold(spark, d)), "share")


_THREADS = "th AS (SELECT story_id, t AS id FROM (SELECT DISTINCT story_id FROM ev), (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'refund']) AS t))"


def _threads(ev):
    names = ("view", "click", "purchase", "signup", "error", "refund")
    each = F.posexplode(F.array(*[F.lit(x) for x in names])).alias("ord", "id")
    return ev.select("story_id").distinct().select("story_id", each).withColumn("label", F.concat(F.lit("Inspector "), F.initcap("id"), F.lit(", a thread")))


@query("thread_counts", f"WITH {_EV}, {_THREADS} SELECT th.story_id, th.id AS thread_id, count(ev.id) AS n_events FROM th LEFT JOIN ev ON ev.story_id = th.story_id AND ev.thread_id = th.id GROUP BY 1, 2")
def _(spark, d):
    ev = _events(spark, d)
    return stories.thread_counts(_threads(ev), ev)


@query("cross_thread_edges", f"WITH {_GOLD} SELECT g.story_id, count(*) FILTER (p.thread_id <> q.thread_id) AS n_cross FROM gold g JOIN ev p ON p.story_id = g.story_id AND p.id = node_i JOIN ev q ON q.story_id = g.story_id AND q.id = node_j GROUP BY 1")
def _(spark, d):
    ev = _events(spark, d)
    return stories.cross_counts(_links(ev), ev)


@query("story_problems", f"""WITH {_PAIRS}, {_THREADS}, c AS (SELECT th.story_id, th.id, count(ev.id) AS n FROM th LEFT JOIN ev ON ev.story_id = th.story_id AND ev.thread_id = th.id GROUP BY 1, 2),
cr AS (SELECT g.story_id, count(*) FILTER (p.thread_id <> q.thread_id) AS n FROM gold g JOIN ev p ON p.story_id = g.story_id AND p.id = node_i JOIN ev q ON q.story_id = g.story_id AND q.id = node_j GROUP BY 1)
SELECT 'events_per_thread' AS problem, count(*) AS n FROM c WHERE n NOT BETWEEN 9 AND 12 UNION ALL SELECT 'cross_thread_edges', count(*) FROM cr WHERE n NOT BETWEEN 3 AND 7
UNION ALL SELECT 'opens_with_own_name', count(*) FROM ev WHERE {_OPENS} UNION ALL SELECT 'convergence_without_instant', count(*) FROM gp JOIN ev p ON p.story_id = gp.story_id AND p.id = gp.a JOIN ev q ON q.story_id = gp.story_id AND q.id = gp.b WHERE NOT (p.s = q.s OR p.s = q.e OR p.e = q.s OR p.e = q.e)""")
def _(spark, d):
    ev, pairs, _ = _pairs(spark, d)
    return stories.problems(_threads(ev), ev, _links(ev), pairs).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("twin_signature", f"WITH {_EV} SELECT story_id, story_id % 2 = 0 OR count(*) < 2 AS same FROM ev GROUP BY 1")
def _(spark, d):
    """A twin whose odd stories miss an edge."""
    ev, pairs, _ = _pairs(spark, d)
    gold = stories.gold_edges(_links(ev), ev)
    twin = gold.where(~((F.col("story_id") % 2 == 1) & (F.col("ord") == 12)))
    a = stories.signature(ev, gold, pairs).withColumnRenamed("signature", "x")
    return a.join(stories.signature(ev, twin, pairs), "story_id").select("story_id", (F.col("x") == F.col("signature")).alias("same"))


@query("linear_isomorphism", f"WITH {_EV} SELECT story_id, NOT (story_id % 3 = 0 AND count(*) > 1) AS same FROM ev GROUP BY 1")
def _(spark, d):
    """Every third story has a changed label in its linear form."""
    ev, pairs, _ = _pairs(spark, d)
    gold = stories.gold_edges(_links(ev), ev)
    ids = stories.linear_ids(narrative.finish(_nested(spark, d)).select("story_id", "global_order"))
    told = gold.withColumn("rel", F.when((F.col("story_id") % 3 == 0) & (F.col("ord") == 12), (F.col("rel") + 1) % 13).otherwise(F.col("rel")))
    rest = lambda edges: (ev.select("story_id", "id"), edges.select("story_id", "node_i", "node_j", "rel"), pairs)
    return stories.isomorphic(rest(gold), stories.relabel(ids, *rest(told)), ids)


@query("variant_project", "SELECT c_custkey AS story_id, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'Twin ' || c_name END AS title, c_mktsegment AS source FROM customer")
def _(spark, d):
    c = views.table(spark, d, "customer")
    twin = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Twin "), "c_name"))
    rows = c.select(F.col("c_custkey").alias("story_id"), F.col("c_name").alias("title"), twin.alias("cf_title"), F.col("c_mktsegment").alias("source"))
    return stories.variant(rows, True, ["title"])


@query("counterfactual_rename", "SELECT p_partkey AS id, replace(replace(replace(p_name, 'a', 'e'), 'e', 'i'), 'Part', 'Piece') AS text FROM part")
def _(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), stories.rename(F.col("p_name"), [("a", "e"), ("e", "i"), ("Part", "Piece")]).alias("text"))


@query("trim_cascade", f"WITH {_GOLD}, k AS (SELECT * FROM ev WHERE thread_id <> 'error') SELECT g.story_id, node_i, node_j FROM gold g JOIN k a ON a.story_id = g.story_id AND a.id = node_i JOIN k b ON b.story_id = g.story_id AND b.id = node_j")
def _(spark, d):
    ev, pairs, _ = _pairs(spark, d)
    gone = ev.where("thread_id = 'error'").select("story_id", "thread_id").distinct()
    return stories.drop_thread(ev, _links(ev), pairs, gone)[1].select("story_id", "node_i", "node_j")


@query("text_update", f"WITH {_EV} SELECT story_id, id, CASE WHEN ord = 2 THEN 'changed' ELSE {_TEXT} END AS text FROM ev")
def _(spark, d):
    ev = _events(spark, d)
    changes = ev.where("ord = 2").select("story_id", "id", F.lit("changed").alias("text"))
    return stories.update_text(ev, changes).select("story_id", "id", "text")


@query("degraded_edges", f"WITH {_GOLD} SELECT story_id, node_i, node_j, CASE WHEN ord = 23 THEN 'equals' ELSE {sql_label('rel', N2)} END AS relation FROM gold WHERE ord <> 34")
def _(spark, d):
    gold = _gold(spark, d)
    over = gold.where("ord IN (23, 34)").select("story_id", "node_i", "node_j", F.when(F.col("ord") == 23, 0).alias("new_rel"))
    return stories.degrade(gold, over).select("story_id", "node_i", "node_j", label("rel", allen.RELATIONS).alias("relation"))


@query("passage_text", f"WITH {_EV} SELECT story_id, string_agg('[' || id || '] ' || {_TEXT}, chr(10) ORDER BY ord) AS passage FROM ev GROUP BY 1")
def _(spark, d):
    return stories.passage(_events(spark, d))


@query("id_normalize", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 's' ELSE '' END || c_custkey AS raw, 's' || c_custkey AS id FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    raw = F.concat(F.when(k % 2 == 0, "s").otherwise(""), k.cast("string"))
    return views.table(spark, d, "customer").select(k.alias("k"), raw.alias("raw"), stories.normalized_id(raw).alias("id"))


_RATE = f"rt AS (SELECT th.story_id, th.id AS thread_id, coalesce(avg({_OPENS}::INT), 0.0)::DOUBLE AS rate FROM th LEFT JOIN ev ON ev.story_id = th.story_id AND ev.thread_id = th.id GROUP BY 1, 2)"
_GUESS = "gs AS (SELECT story_id, id, thread_id AS g, CASE kind WHEN 1 THEN NULL WHEN 2 THEN 'click' ELSE thread_id END AS p FROM ev), ct AS (SELECT story_id, g, p, count(*) AS n FROM gs WHERE p IS NOT NULL GROUP BY 1, 2, 3)"


@query("name_opening_rate", f"WITH {_EV}, {_THREADS}, {_RATE} SELECT story_id, thread_id, round(rate, 9) AS rate FROM rt")
def _(spark, d):
    ev = _events(spark, d)
    return _rounded(stories.name_opening_rate(_threads(ev), ev), "rate")


@query("lexical_baseline", f"WITH {_EV}, {_GUESS} SELECT story_id, id, p AS thread_id FROM gs")
def _(spark, d):
    ev = _events(spark, d)
    return stories.lexical_baseline(_threads(ev), ev)


@query("leakage_audit", f"""WITH RECURSIVE {_EV}, {_THREADS}, {_RATE}, {_GUESS}, {_BEST} SELECT story_id, round(max(rate), 9) AS worst_rate, round(max(thread_accuracy), 9) AS baseline_accuracy, max(rate) > {stories.NAME_OPENING} OR max(thread_accuracy) > {stories.BASELINE} AS leaks FROM rt JOIN acc USING (story_id) GROUP BY 1""")
def _(spark, d):
    ev = _events(spark, d)
    return _rounded(stories.leakage(_threads(ev), ev), "worst_rate", "baseline_accuracy")


@query("edge_display", f"WITH {_SCORED} SELECT story_id, node_i, node_j, round(score * 120)::BIGINT AS hue FROM sc")
def _(spark, d):
    return narrative.display(_scored(spark, d)).select("story_id", "node_i", "node_j", F.col("hue").cast("long"))


@query("node_mean_score", f"WITH {_SCORED}, n AS (SELECT story_id, node_i AS id, score FROM sc UNION ALL SELECT story_id, node_j, score FROM sc) SELECT story_id, id, round(avg(score), 9) AS mean_score FROM n GROUP BY 1, 2")
def _(spark, d):
    return _rounded(narrative.node_scores(_scored(spark, d)).select("story_id", "id", "mean_score"), "mean_score")


@query("node_degree", f"WITH {_GOLD}, n AS (SELECT story_id, node_i AS id FROM gold UNION ALL SELECT story_id, node_j FROM gold) SELECT story_id, id, count(*) AS degree, round(least(0.5, 0.18 + 0.045 * count(*))::DOUBLE, 9) AS radius FROM n GROUP BY 1, 2")
def _(spark, d):
    return _rounded(narrative.node_scores(_gold(spark, d).withColumn("score", F.lit(0.0))).select("story_id", "id", "degree", "radius"), "radius")


def _paired(spark, d):
    """Customers' balances against those of the next customer of their nation."""
    c = views.table(spark, d, "customer")
    nxt = F.lead("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return c.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("a"), nxt.alias("b")).where("b IS NOT NULL")


@query("wilcoxon_stat", """WITH p AS (SELECT c_nationkey AS nation, c_acctbal - lead(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS d FROM customer), q AS (SELECT * FROM p WHERE d IS NOT NULL),
r AS (SELECT nation, d, rank() OVER (PARTITION BY nation ORDER BY abs(d)) + (count(*) OVER (PARTITION BY nation, abs(d)) - 1) / 2 AS k FROM q WHERE d <> 0),
s AS (SELECT nation, least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) AS w FROM r GROUP BY 1)
SELECT q.nation, count(*) AS n, round(coalesce(max(w), 0.0)::DOUBLE, 6) AS statistic, round(avg(d), 6) AS mean_diff FROM q LEFT JOIN s USING (nation) GROUP BY 1""")
def _(spark, d):
    got = statistics.signed_rank(_paired(spark, d), "nation")
    return got.select("nation", "n", F.round("statistic", 6).alias("statistic"), F.round("mean_diff", 6).alias("mean_diff"))


@query("wilcoxon_p", """WITH p AS (SELECT c_nationkey AS nation, c_acctbal - lead(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS d FROM customer), q AS (SELECT * FROM p WHERE d IS NOT NULL),
r AS (SELECT nation, d, rank() OVER (PARTITION BY nation ORDER BY abs(d)) + (count(*) OVER (PARTITION BY nation, abs(d)) - 1) / 2 AS k, count(*) OVER (PARTITION BY nation, abs(d)) AS t FROM q WHERE d <> 0),
s AS (SELECT nation, least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END))::DOUBLE AS w, count(*) AS m, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1),
z AS (SELECT *, least(abs(w - m * (m + 1) / 4) / sqrt(greatest(1e-300, m * (m + 1) * (2 * m + 1) / 24 - ties / 48)) / sqrt(2), 5.0) AS x FROM s)
SELECT nation, round(least(1.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(120), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * CASE WHEN x = 0 THEN 0 ELSE exp((2 * i + 1) * ln(x) - lgamma(i + 1.0)) / (2 * i + 1) END))), 5) AS p_value FROM z WHERE m > 50""")
def _(spark, d):
    """The normal approximation, for groups of more than fifty differences; a test looks at the exact p of smaller ones."""
    got = statistics.signed_rank(_paired(spark, d), "nation")
    return got.join(_paired(spark, d).where("a <> b").groupBy("nation").count(), "nation").where(F.col("count") > statistics.EXACT).select("nation", F.round("p_value", 5).alias("p_value"))


@query("bootstrap_ci")
def _(spark, d):
    values = views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    return statistics.bootstrap(values, "nation", "v")
