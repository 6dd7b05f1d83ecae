"""Queries of temporal expressions, statements and the benchmark, and their SQL.

The driver's texts hold no temporal expressions, so statements are built from its dates and numbers. The SQL works out
the expected results from those same columns, not by matching the text again, wherever it can.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import allen, spans
from chronoweave.operators import evaluation, statements
from chronoweave.sources import benchmark

from . import views

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _orders(spark, d):
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))


def _flat(rows, family, *fields):
    """One row a hit: k, raw, start_char, end_char and the fields."""
    hit = F.explode(spans.family(F.col("text"), family)).alias("e")
    return rows.select("k", hit).select("k", F.col("e.raw").alias("raw"), F.col("e.start").cast("long").alias("start_char"), F.col("e.stop").cast("long").alias("end_char"), *[F.col(f"e.{f}").cast("string").alias(f) for f in fields])


_WORD = "list_extract(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], (k % 10 + 1)::INT + 1)"
_UNIT = "list_extract(['second', 'minute', 'hour', 'day', 'week', 'month', 'year'], (k % 7)::INT + 1)"
_DAY = "list_extract(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], (k % 7)::INT + 1)"
_MOD = "list_extract(['last', 'next', 'this'], (k % 3)::INT + 1)"
_O = "o AS (SELECT o_orderkey AS k, o_orderdate AS t FROM orders)"


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


_UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def _number(k):
    return _pick(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"), k % 10 + 1)


@query("extract_iso", f"WITH {_O} SELECT k, strftime(t, '%Y-%m-%d') AS raw, (6 + length(k::VARCHAR) + 8)::BIGINT AS start_char, (6 + length(k::VARCHAR) + 18)::BIGINT AS end_char, year(t)::VARCHAR AS year, month(t)::VARCHAR AS month, day(t)::VARCHAR AS day FROM o")
def _(spark, d):
    rows = _orders(spark, d).withColumn("text", F.concat(F.lit("Order "), F.col("k").cast("string"), F.lit(" placed "), F.date_format("t", "yyyy-MM-dd"), F.lit(" by mail")))
    return _flat(rows, "iso", "year", "month", "day")


@query("extract_written", f"WITH {_O} SELECT k, 'on ' || day(t) || ' ' || strftime(t, '%B') || ' ' || year(t) AS raw, (6 + length(k::VARCHAR))::BIGINT AS start_char, (6 + length(k::VARCHAR) + length('on ' || day(t) || ' ' || strftime(t, '%B') || ' ' || year(t)))::BIGINT AS end_char, year(t)::VARCHAR AS year, month(t)::VARCHAR AS month, day(t)::VARCHAR AS day FROM o")
def _(spark, d):
    rows = _orders(spark, d).withColumn("text", F.concat(F.lit("Order"), F.col("k").cast("string"), F.date_format("t", "' on 'd MMMM yyyy'; paid'")))
    return _flat(rows, "day_month", "year", "month", "day")


@query("extract_month_day", f"WITH {_O} SELECT k, strftime(t, '%b') || ' ' || day(t) || CASE WHEN k % 2 = 0 THEN ', ' || year(t) ELSE '' END AS raw, 5::BIGINT AS start_char, (5 + length(strftime(t, '%b') || ' ' || day(t) || CASE WHEN k % 2 = 0 THEN ', ' || year(t) ELSE '' END))::BIGINT AS end_char, CASE WHEN k % 2 = 0 THEN year(t)::VARCHAR END AS year, month(t)::VARCHAR AS month, day(t)::VARCHAR AS day FROM o")
def _(spark, d):
    rows = _orders(spark, d).withColumn("text", F.concat(F.lit("Paid "), F.date_format("t", "MMM d"), F.when(F.col("k") % 2 == 0, F.date_format("t", "', 'yyyy")).otherwise(F.lit("")), F.lit(" in full")))
    return _flat(rows, "month_day", "year", "month", "day")


@query("extract_time", """SELECT event_id AS k, 'at ' || ((hour(ts) + 11) % 12 + 1) || ':' || strftime(ts, '%M') || CASE WHEN hour(ts) >= 12 THEN ' pm' ELSE ' am' END AS raw, 9::BIGINT AS start_char,
  (9 + length('at ' || ((hour(ts) + 11) % 12 + 1) || ':' || strftime(ts, '%M')) + 3)::BIGINT AS end_char, hour(ts)::VARCHAR AS hour, minute(ts)::VARCHAR AS minute, '0' AS second FROM events""")
def _(spark, d):
    ev = views.table(spark, d, "events")
    h = F.hour("ts")
    half = F.when(h >= 12, " pm").otherwise(" am")
    rows = ev.select(F.col("event_id").alias("k"), F.concat(F.lit("It began at "), ((h + 11) % 12 + 1).cast("string"), F.lit(":"), F.date_format("ts", "mm"), half, F.lit(", sharp")).alias("text"))
    return _flat(rows, "time", "hour", "minute", "second")


@query("extract_offset", f"WITH {_O} SELECT k, {_WORD} || ' ' || {_UNIT} || 's ' || CASE WHEN k % 2 = 0 THEN 'ago' ELSE 'later' END AS raw, 7::BIGINT AS start_char, (7 + length({_WORD} || ' ' || {_UNIT} || 's ' || CASE WHEN k % 2 = 0 THEN 'ago' ELSE 'later' END))::BIGINT AS end_char, (k % 10 + 1)::VARCHAR AS value, {_UNIT} AS unit, CASE WHEN k % 2 = 0 THEN 'past' ELSE 'future' END AS direction FROM o")
def _(spark, d):
    k = F.col("k")
    rows = _orders(spark, d).withColumn("text", F.concat(F.lit("It was "), _number(k), F.lit(" "), _pick(_UNITS, k % 7), F.lit("s "), F.when(k % 2 == 0, "ago").otherwise("later")))
    return _flat(rows, "offset", "value", "unit", "direction")


@query("extract_named", f"WITH {_O} SELECT k, list_extract(['today', 'yesterday', 'tomorrow'], (k % 3)::INT + 1) AS raw, 4::BIGINT AS start_char, (4 + length(list_extract(['today', 'yesterday', 'tomorrow'], (k % 3)::INT + 1)))::BIGINT AS end_char, list_extract(['0', '-1', '1'], (k % 3)::INT + 1) AS offset_days FROM o")
def _(spark, d):
    rows = _orders(spark, d).withColumn("text", F.concat(F.lit("Due "), _pick(("today", "yesterday", "tomorrow"), F.col("k") % 3), F.lit(" at last")))
    return _flat(rows, "named", "offset_days")


@query("extract_weekday", f"WITH {_O} SELECT k, upper({_MOD}) || ' ' || {_DAY} AS raw, 4::BIGINT AS start_char, (5 + length({_MOD}) + length({_DAY}))::BIGINT AS end_char, {_MOD} AS modifier, {_DAY} AS weekday FROM o")
def _(spark, d):
    k = F.col("k")
    rows = _orders(spark, d).withColumn("text", F.concat(F.lit("Due "), F.upper(_pick(("last", "next", "this"), k % 3)), F.lit(" "), _pick(spans.WEEKDAYS, k % 7), F.lit(", maybe")))
    return _flat(rows, "weekday", "modifier", "weekday")


@query("extract_duration", f"WITH {_O} SELECT k, 'for ' || (k % 90 + 1) || ' ' || {_UNIT} || 's' AS raw, 7::BIGINT AS start_char, (7 + length('for ' || (k % 90 + 1) || ' ' || {_UNIT} || 's'))::BIGINT AS end_char, (k % 90 + 1)::VARCHAR AS value, {_UNIT} AS unit FROM o WHERE k % 2 = 0")
def _(spark, d):
    k = F.col("k")
    cue = F.when(k % 2 == 0, "It ran for ").otherwise("It took ")
    rows = _orders(spark, d).withColumn("text", F.concat(cue, (k % 90 + 1).cast("string"), F.lit(" "), _pick(_UNITS, k % 7), F.lit("s.")))
    return _flat(rows, "duration", "value", "unit")


@query("extract_all_spans", f"""WITH {_O}, p AS (SELECT k, 'on 3 May 2021' AS a, strftime(t, '%Y-%m-%d') AS b, {_WORD} || ' ' || {_UNIT} || 's ago' AS c, 'tomorrow' AS e, {_MOD} || ' ' || {_DAY} AS f, 'for ' || {_WORD} || ' ' || {_UNIT} || 's' AS g FROM o),
x AS (SELECT *, length(a) + 2 AS sb, length(a) + 2 + length(b) + 2 AS sc, length(a) + length(b) + length(c) + 6 AS se, length(a) + length(b) + length(c) + length(e) + 8 AS sf, length(a) + length(b) + length(c) + length(e) + length(f) + 10 AS sg FROM p)
SELECT k, a AS raw, 'ABSOLUTE_DATE' AS type, 0::BIGINT AS start_char FROM x UNION ALL SELECT k, b, 'ABSOLUTE_DATE', sb::BIGINT FROM x UNION ALL SELECT k, c, 'RELATIVE_DATE', sc::BIGINT FROM x
UNION ALL SELECT k, e, 'RELATIVE_DATE', se::BIGINT FROM x UNION ALL SELECT k, f, 'RELATIVE_DATE', sf::BIGINT FROM x UNION ALL SELECT k, g, 'DURATION', sg::BIGINT FROM x""")
def _(spark, d):
    k = F.col("k")
    span = F.concat(_number(k), F.lit(" "), _pick(_UNITS, k % 7), F.lit("s"))
    parts = [F.lit("on 3 May 2021"), F.date_format("t", "yyyy-MM-dd"), F.concat(span, F.lit(" ago")), F.lit("tomorrow"), F.concat(_pick(("last", "next", "this"), k % 3), F.lit(" "), _pick(spans.WEEKDAYS, k % 7)), F.concat(F.lit("for "), span)]
    rows = _orders(spark, d).withColumn("text", F.concat_ws("; ", *parts))
    return rows.select("k", F.explode(spans.extract(F.col("text"))).alias("e")).select("k", F.col("e.raw").alias("raw"), F.col("e.type").alias("type"), F.col("e.start").cast("long").alias("start_char"))


def _resolved(rows, anchor=None):
    e = F.get(spans.normalize(spans.extract(F.col("text")), anchor), F.lit(0)).alias("e")
    return rows.select("k", e).select("k", F.date_format("e.resolved_ts", "yyyy-MM-dd HH:mm:ss").alias("resolved"), F.floor(F.col("e.resolved_us") / 1000000).alias("seconds"))


_T = "'%Y-%m-%d %H:%M:%S'"
_SECONDS = "list_extract([1, 60, 3600, 86400, 604800, 2592000, 31536000], (k % 7)::INT + 1)"


@query("normalize_absolute", f"WITH {_O} SELECT k, strftime(CASE WHEN k % 2 = 0 THEN date_trunc('day', t) ELSE make_timestamp(2026, month(t), day(t), 0, 0, 0.0) END, {_T}) AS resolved FROM o WHERE NOT (month(t) = 2 AND day(t) = 29)")
def _(spark, d):
    o = _orders(spark, d).where(~((F.month("t") == 2) & (F.dayofmonth("t") == 29)))
    return _resolved(o.withColumn("text", F.when(F.col("k") % 2 == 0, F.date_format("t", "yyyy-MM-dd")).otherwise(F.date_format("t", "MMMM d")))).drop("seconds")


@query("normalize_time", f"SELECT event_id AS k, '2026-09-13 ' || strftime(ts, '%H:%M:%S') AS resolved FROM events")
def _(spark, d):
    return _resolved(views.table(spark, d, "events").select(F.col("event_id").alias("k"), F.date_format("ts", "'at 'HH:mm:ss").alias("text"))).drop("seconds")


@query("normalize_offset", f"WITH {_O}, s AS (SELECT k, CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * (k % 10 + 1) * {_SECONDS}::BIGINT AS sec FROM o) SELECT k, strftime(TIMESTAMP '2026-09-13' + to_seconds(sec), {_T}) AS resolved, sec AS seconds FROM s")
def _(spark, d):
    k = F.col("k")
    return _resolved(_orders(spark, d).withColumn("text", F.concat(_number(k), F.lit(" "), _pick(_UNITS, k % 7), F.lit("s "), F.when(k % 2 == 0, "earlier").otherwise("after"))))


@query("normalize_named", f"WITH {_O} SELECT k, strftime(TIMESTAMP '2026-09-13' + to_days(list_extract([0, -1, 1], (k % 3)::INT + 1)), {_T}) AS resolved, (list_extract([0, -1, 1], (k % 3)::INT + 1) * 86400)::BIGINT AS seconds FROM o")
def _(spark, d):
    return _resolved(_orders(spark, d).withColumn("text", _pick(("today", "yesterday", "tomorrow"), F.col("k") % 3)))


@query("normalize_weekday", f"""WITH {_O}, w AS (SELECT k, t, (k % 7)::INT AS target, isodow(t) - 1 AS today FROM o), x AS (SELECT k, t, CASE k % 3 WHEN 0 THEN -CASE WHEN (today - target + 7) % 7 = 0 THEN 7 ELSE (today - target + 7) % 7 END
  WHEN 1 THEN CASE WHEN (target - today + 7) % 7 = 0 THEN 7 ELSE (target - today + 7) % 7 END ELSE target - today END AS days FROM w)
SELECT k, strftime(t + to_days(days::INT), {_T}) AS resolved, (days * 86400)::BIGINT AS seconds FROM x""")
def _(spark, d):
    k = F.col("k")
    rows = _orders(spark, d).withColumn("text", F.concat(_pick(("last", "next", "this"), k % 3), F.lit(" "), _pick(spans.WEEKDAYS, k % 7)))
    return _resolved(rows, F.col("t"))


@query("normalize_duration", f"WITH {_O} SELECT k, ((k % 90 + 1) * {_SECONDS})::BIGINT AS seconds FROM o")
def _(spark, d):
    k = F.col("k")
    return _resolved(_orders(spark, d).withColumn("text", F.concat(F.lit("lasted for "), (k % 90 + 1).cast("string"), F.lit(" "), _pick(_UNITS, k % 7), F.lit("s")))).drop("resolved")


@query("parse_duration_text", f"WITH {_O} SELECT k, ((k % 50 + 1) * list_extract([60, 3600, 86400, 1], (k % 4)::INT + 1))::BIGINT AS seconds FROM o")
def _(spark, d):
    k = F.col("k")
    text = F.concat((k % 50 + 1).cast("string"), _pick((" minutes", "h", " days", "sec"), k % 4))
    return _orders(spark, d).select("k", F.floor(spans.parse_duration_us(text) / 1000000).alias("seconds"))


@query("parse_iso_text", f"WITH {_O} SELECT k, strftime(t, {_T}) AS resolved FROM o")
def _(spark, d):
    return _orders(spark, d).select("k", F.date_format(spans.parse_iso(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("resolved"))


@query("sentence_split", r"SELECT doc_id, count(*)::BIGINT AS n, max(length(s))::BIGINT AS longest FROM (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '[;\n.]+')), '^\s+|\s+$', '', 'g') AS s FROM documents) WHERE s <> '' GROUP BY 1")
def _(spark, d):
    got = views.table(spark, d, "documents").select("doc_id", F.explode(statements.sentences(F.col("text"))).alias("s"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("entity_clean", "WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders) SELECT k, CASE k % 3 WHEN 0 THEN 'Order ' || k WHEN 1 THEN p ELSE 'arrived' END AS entity FROM o")
def _(spark, d):
    o = views.table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Order "), k.cast("string"), F.lit(" arrived"))).when(k % 3 == 1, F.concat(F.lit("LEFT "), "o_orderpriority")).otherwise("arrived")
    return o.select(k.alias("k"), statements.clean_entity(text).alias("entity"))


#: Statements of a customer's order k, by k modulo 10, and what each is.
_KINDS = (
    ("Order_{k} before Order_{n}", "RELATION", "before"), ("Order_{k} occurred after Order_{n}", "RELATION", "after"), ("Order_{k} is during Order_{n}", "RELATION", "during"), ("Order_{k} meets Order_{n}", "RELATION", "meets"),
    ("Order_{k} includes Order_{n}", "RELATION", "contains"), ("Order_{k} starts Order_{n}", "RELATION", "starts"), ("Order_{k} finished Order_{n}", "RELATION", "finishes"), ("Order_{k} equals Order_{n}", "RELATION", "equal"),
    ("Order_{k} started at 10:30", "EVENT_BOUND", "start"), ("Order_{k} ended at 11:45", "EVENT_BOUND", "end"), ("It lasted for 90 minutes", "EVENT_BOUND", "duration"), ("Order_{k} took 90 minutes", "UNPARSED", None),
)


def _statements(spark, d):
    """One document a customer, one statement an order; the number of the next order is k + 1."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("epoch"))
    text = F.lit(None)
    for i, (pattern, _, _) in enumerate(_KINDS):
        made = F.replace(F.replace(F.lit(pattern), F.lit("{k}"), F.col("epoch").cast("string")), F.lit("{n}"), (F.col("epoch") + 1).cast("string"))
        text = F.when(F.col("epoch") % len(_KINDS) == i, made).otherwise(text)
    return o.withColumn("text", text)


_S = f"s AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderkey % {len(_KINDS)} AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)"
_case = lambda i: "CASE m " + " ".join(f"WHEN {m} THEN {repr(kind[i]) if kind[i] else 'NULL'}" for m, kind in enumerate(_KINDS)) + " END"


@query("statement_classify", f"WITH {_S} SELECT doc_id, k, {_case(1)} AS statement_type, CASE WHEN m < 8 THEN {_case(2)} END AS relation, CASE WHEN m >= 8 THEN {_case(2)} END AS bound_type, CASE m WHEN 8 THEN '10:30' WHEN 9 THEN '11:45' END AS clock, CASE m WHEN 10 THEN 5400::BIGINT ELSE 0 END AS seconds FROM s")
def _(spark, d):
    p = statements.parse(_statements(spark, d))
    return p.select("doc_id", F.col("epoch").alias("k"), "statement_type", allen.label(F.col("rel")).alias("relation"), "bound_type", F.date_format("bound_ts", "HH:mm").alias("clock"), F.floor(F.coalesce("bound_us", F.lit(0)) / 1000000).alias("seconds"))


_MENTIONS = f"""{_S}, m AS (SELECT doc_id, pos, 0 AS i, CASE WHEN m = 10 THEN CASE WHEN pos = 1 THEN 'It' END ELSE 'Order_' || k END AS name FROM s
  UNION ALL SELECT doc_id, pos, 1, CASE WHEN m < 8 THEN 'Order_' || (k + 1) WHEN m = 11 THEN 'Order_' || k || ' took 90 minutes' END FROM s)"""


@query("event_id_assign", f"WITH {_MENTIONS}, f AS (SELECT doc_id, name, min(pos * 10 + i) AS place FROM m WHERE name IS NOT NULL GROUP BY 1, 2) SELECT doc_id, name AS description, 'E' || row_number() OVER (PARTITION BY doc_id ORDER BY place) AS event_id FROM f")
def _(spark, d):
    return statements.event_ids(statements.parse(_statements(spark, d))).select("doc_id", "description", "event_id")


_LAST = f"""{_S}, l AS (SELECT *, CASE WHEN m = 10 THEN CASE WHEN pos = 1 THEN 'It' END WHEN m < 8 THEN 'Order_' || (k + 1) WHEN m = 11 THEN 'Order_' || k || ' took 90 minutes' ELSE 'Order_' || k END AS own FROM s),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS last_event FROM l)"""


@query("coref_last_event", f"WITH {_LAST} SELECT doc_id, k, last_event FROM c WHERE m = 10")
def _(spark, d):
    p = statements.parse(_statements(spark, d)).where("bound_type = 'duration'")
    return p.select("doc_id", F.col("epoch").alias("k"), F.col("source").alias("last_event"))


@query("bound_last_write", f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back, o_orderkey % 12 + 1 AS h FROM orders)
SELECT doc_id, 'The meeting' AS description, strftime(TIMESTAMP '2026-09-13' + to_hours(h::INT), '%H:%M') AS start_time FROM o WHERE back = 1""")
def _(spark, d):
    """Every order states the start of the same event anew; the last statement holds."""
    o = views.table(spark, d, "orders")
    said = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("epoch"), F.concat(F.lit("The meeting began at "), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit(":00")).alias("text"))
    p = statements.parse(said)
    got = statements.events(p, statements.event_ids(p))
    return got.select("doc_id", "description", F.date_format("start_time", "HH:mm").alias("start_time"))


@query("explicit_edges", f"WITH {_S} SELECT doc_id, 'Order_' || k AS source, 'Order_' || (k + 1) AS target, {_case(2)} AS relation FROM s WHERE m < 8")
def _(spark, d):
    p = statements.parse(_statements(spark, d))
    ids = statements.event_ids(p)
    e = statements.edges(p, ids)
    name = lambda c, new: ids.select("doc_id", F.col("event_id").alias(c), F.col("description").alias(new))
    return e.join(name("src", "source"), ["doc_id", "src"]).join(name("tgt", "target"), ["doc_id", "tgt"]).select("doc_id", "source", "target", allen.label(F.col("rel")).alias("relation"))


_GEN = """g AS (
  SELECT 'eo' AS p, 'event ordering' AS category, i, CASE WHEN i % 2 = 1 THEN 'before' ELSE 'after' END AS expected FROM range(1, 26) t(i)
  UNION ALL SELECT 'ti', 'transitive inference', i, 'before' FROM range(1, 26) t(i)
  UNION ALL SELECT 'ir', 'inverse relations', i, CASE WHEN i % 2 = 1 THEN 'after' ELSE 'contains' END FROM range(1, 21) t(i)
  UNION ALL SELECT 'int', 'interval relations', i, list_extract(['meets', 'during', 'contains', 'equal'], (i % 4 + 1)::INT) FROM range(1, 21) t(i)
  UNION ALL SELECT 'rd', 'relative dates', i, 'before' FROM range(1, 16) t(i)
  UNION ALL SELECT 'dur', 'durations', i, 'before' FROM range(1, 16) t(i)
  UNION ALL SELECT 'contra', 'contradictions', i, NULL FROM range(1, 16) t(i)
  UNION ALL SELECT 'mix', 'mixed temporal expressions', i, 'before' FROM range(1, 16) t(i))"""


@query("bench_generate", f"WITH {_GEN} SELECT p || '_' || lpad(i::VARCHAR, 3, '0') AS id, category, expected, category <> 'contradictions' AS is_consistent FROM g")
def _(spark, d):
    return benchmark.generate(spark).select("id", "category", "expected", "is_consistent")


@query("bench_eval_detail", f"WITH {_GEN} SELECT p || '_' || lpad(i::VARCHAR, 3, '0') AS id, category, expected, coalesce(expected, 'before') AS predicted, expected IS NOT NULL AS expected_consistent, expected IS NOT NULL AS predicted_consistent, true AS is_correct FROM g")
def _(spark, d):
    return evaluation.evaluate(benchmark.generate(spark)).drop("is_inferred")


@query("bench_overall", "SELECT 150::BIGINT AS total, 150::BIGINT AS correct, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS explicit_accuracy, 1.0::DOUBLE AS inferred_accuracy, 1.0::DOUBLE AS consistency_rate")
def _(spark, d):
    return evaluation.overall(evaluation.evaluate(benchmark.generate(spark)))


@query("bench_category", f"WITH {_GEN} SELECT category, count(*) AS total, count(*) AS correct, 1.0::DOUBLE AS accuracy FROM g GROUP BY 1")
def _(spark, d):
    return evaluation.by_category(evaluation.evaluate(benchmark.generate(spark)))


@query("bench_confusion_macro", f"WITH {_GEN} SELECT expected AS label, count(*) AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM g WHERE expected IS NOT NULL GROUP BY 1")
def _(spark, d):
    return evaluation.confusion(evaluation.evaluate(benchmark.generate(spark)))


