"""Extraction, parsing, inference, contradictions and evaluation on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoweave import cli
from chronoweave.functions import allen, spans
from chronoweave.operators import evaluation, graphs, statements
from chronoweave.session import TemporalSession
from chronoweave.sources import benchmark, graphs_io, models
from chronoweave.streaming import incremental


def extracted(spark, text, anchor=None):
    return spark.createDataFrame([(text,)], "t string").select(spans.normalize(spans.extract(F.col("t")), anchor).alias("x")).first().x


@pytest.mark.parametrize(
    "text,raw,type_,ts,us",
    [
        ("due 2026-09-10.", "2026-09-10", "ABSOLUTE_DATE", datetime(2026, 9, 10), None),
        ("on 12th March 2026", "on 12th March 2026", "ABSOLUTE_DATE", datetime(2026, 3, 12), None),
        ("March 12, 2026", "March 12, 2026", "ABSOLUTE_DATE", datetime(2026, 3, 12), None),
        ("March 12", "March 12", "ABSOLUTE_DATE", datetime(2026, 3, 12), None),
        ("at 12:05 am", "at 12:05 am", "TIME", datetime(2026, 9, 13, 0, 5), None),
        ("two days ago", "two days ago", "RELATIVE_DATE", datetime(2026, 9, 11), -2 * spans.DAY_US),
        ("3 weeks later", "3 weeks later", "RELATIVE_DATE", datetime(2026, 10, 4), 21 * spans.DAY_US),
        ("tomorrow", "tomorrow", "RELATIVE_DATE", datetime(2026, 9, 14), spans.DAY_US),
        ("a month ago", "a month ago", "RELATIVE_DATE", datetime(2026, 8, 14), -30 * spans.DAY_US),
        ("it lasted for 90 minutes", "for 90 minutes", "DURATION", None, 90 * 60_000_000),
    ],
)
def test_expressions(spark, text, raw, type_, ts, us):
    (e,) = extracted(spark, text)
    assert (e.raw, e.type, e.resolved_ts, e.resolved_us, text[e.start : e.stop]) == (raw, type_, ts, us, raw)


def test_weekday_keeps_the_clock(spark):
    (e,) = extracted(spark, "last Monday", datetime(2026, 9, 6, 12))
    assert e.resolved_ts == datetime(2026, 8, 31, 12)


def test_overlaps_and_impossible_dates(spark):
    assert [e.raw for e in extracted(spark, "at 10:30 and adjourned at 2:15 pm, for two hours, 5 minutes before")] == ["at 10:30 ", "at 2:15 pm", "for two hours", "5 minutes before"]
    assert extracted(spark, "2026-13-45")[0].resolved_ts is None and extracted(spark, "") == []


def test_durations_as_text(spark):
    df = spark.createDataFrame([("90m",), ("2 hours",), ("1.5d",), ("30 sec",), ("45",), ("soon",), (None,)], "t string")
    assert [r.u for r in df.select(spans.parse_duration_us(F.col("t")).alias("u")).collect()] == [5400 * 10**6, 7200 * 10**6, 129600 * 10**6, 30 * 10**6, 45 * 10**6, None, None]


def test_large_numbers_are_null_not_errors(spark):
    texts = ["it lasted for 999999 years", "300000 years ago", "9999999999 days ago", "99999999999999999999 days later", "in 0000-00-00", "at 99:99", "9999 years later", "two weeks ago"]
    got = {t: [(e.raw, e.value, e.resolved_ts is None, e.resolved_us) for e in extracted(spark, t)] for t in texts}
    assert got[texts[0]] == [("for 999999 years", 999999, True, None)]
    assert got[texts[1]] == [("300000 years ago", 300000, True, None)] and got[texts[2]] == [("9999999999 days ago", 9999999999, True, None)]
    assert got[texts[3]] == [("99999999999999999999 days later", None, True, None)] and got[texts[6]][0][2]
    assert got[texts[7]][0][3] == -14 * spans.DAY_US and got[texts[4]][0][2] and got[texts[5]] == []
    df = spark.createDataFrame([("99999999999999999999 h",), ("9" * 400 + "d",), ("1e5",)], "t string")
    assert [r.u for r in df.select(spans.parse_duration_us(F.col("t")).alias("u")).collect()] == [None] * 3
    assert parsed(spark, "The meeting lasted 99999999999999999999 years. It started 999999999 years ago.")


def test_table_function(spark):
    spans.register(spark)
    texts = ["at 10:30 and adjourned at 2:15 pm, for two hours, 5 minutes before", "on 12th March 2026 or 2026-03-12", "", None, "May 5 may 5th, dismay 5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df.createOrReplaceTempView("texts")
    got = {(r.i, r.start, r.stop, r.raw, r.type) for r in spark.sql("SELECT i, x.* FROM texts, LATERAL extract_temporal(t) x").collect()}
    want = df.select("i", F.explode(spans.extract(F.col("t"))).alias("e")).select("i", "e.start", "e.stop", "e.raw", "e.type").collect()
    assert got == set(map(tuple, want)) and len(got) >= 8


def chain(spark, n, rel="before"):
    rows = [("d", f"E{i}", f"E{i + 1}", allen.ID[rel], False, 1.0, "explicit", i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, src string, tgt string, rel int, is_inferred boolean, confidence double, provenance string, ord bigint")


def test_long_chains(spark):
    """Closure, paths, cycles and answers over a chain of 70 events, far beyond the registered queries' documents."""
    n, dim = 70, allen.core_dim(spark)
    e = chain(spark, n)
    closed = graphs.closure(e, dim)
    assert closed.where(F.col("rel") == allen.ID["before"]).count() == n * (n + 1) // 2 and closed.count() == n * (n + 1)
    ask = spark.createDataFrame([("d", "E0", f"E{n}"), ("d", f"E{n}", "E0")], "doc_id string, src string, tgt string")
    got = {r.src: r.rel for r in graphs.answer(ask, e).collect()}
    assert got == {"E0": allen.ID["before"], f"E{n}": None}
    assert graphs.cycle_nodes(e).isEmpty()
    loop = e.unionByName(e.limit(1).withColumns({"src": F.lit(f"E{n}"), "tgt": F.lit("E0"), "ord": F.lit(n).cast("bigint")}))
    assert graphs.cycle_nodes(loop).count() == n + 1 and len(graphs.cycle_paths(loop).first().event_ids) == n + 2
    with pytest.raises(ValueError):
        graphs.closure(e, dim, max_rounds=3)


def test_first_derived_comes_first(spark):
    """Rounds number their edges one after another, each round by the edges that it came from."""
    closed = graphs.closure(chain(spark, 11), allen.core_dim(spark)).collect()
    of_round = {}
    for r in closed:
        hops = abs(int(r.src[1:]) - int(r.tgt[1:]))
        of_round.setdefault(r.ord // graphs.ROUND, []).append((r.ord, hops, r.rel))
    assert sorted(of_round) == [0, 2, 3, 4, 5, 6][: len(of_round)] and {h for _, h, _ in of_round[2]} == {1, 2}
    assert [h for _, h, _ in sorted(of_round[2])][:11] == [1] * 11 and len({r.ord for r in closed}) == len(closed)
    two = chain(spark, 2).unionByName(chain(spark, 1, "meets").withColumn("ord", F.lit(9).cast("bigint")))
    assert {(r.src, r.tgt): allen.SYMBOLIC[r.rel] for r in graphs.primary(graphs.closure(two, allen.core_dim(spark))).collect()}["E1", "E0"] == "after"


def test_events_by_epoch(spark):
    """States of events are compared when they hold in one epoch, as if the graph were read after every statement."""
    said = ["A started at 09:00. It lasted for 60 minutes.", "B started at 11:00. It lasted for 60 minutes.", "A started at 14:00.", "C is before B.", "B started at 16:00."]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(said)], "doc_id string, epoch int, text string")
    p, _, closed = statements.graph(rows)
    names = {r.event_id: r.description for r in statements.event_ids(p).collect()}
    got = {(names[r.src], allen.SYMBOLIC[r.rel], names[r.tgt]) for r in closed.collect()}
    want = set()
    for k in range(1, len(said) + 1):
        want |= {(names[r.src], allen.SYMBOLIC[r.rel], names[r.tgt]) for r in statements.graph(rows.where(F.col("epoch") < k), by_epoch=False)[2].collect()}
    assert want <= got and {("A", "before", "B"), ("B", "before", "A"), ("C", "before", "B")} <= got


def test_statement_stream(spark, tmp_path):
    """Statements that arrive as files are parsed batch by batch."""
    for i, text in enumerate(("A before B.", "B before C. It lasted for 2 hours.")):
        spark.createDataFrame([("d", i, text)], "doc_id string, epoch int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    out = []
    lines = spark.readStream.schema("doc_id string, epoch int, text string").json(str(tmp_path / "in"))
    incremental.statement_stream(lines, lambda batch: out.extend((r.statement_type, r.raw) for r in batch.collect()))
    assert sorted(out) == [("EVENT_BOUND", "It lasted for 2 hours"), ("RELATION", "A before B"), ("RELATION", "B before C")]


def test_prompts_and_first_object(spark):
    assert all("{passage}" in p for p in models.PROMPTS.values()) and "{so_far}" in models.PROMPTS["edge"]
    df = spark.createDataFrame([('x {"a": {"b": 1}} y',), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(models.first_object(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None, None]


def test_results_sink(spark, tmp_path, capsys):
    assert cli.main(["-e", "generated", "--save", str(tmp_path / "r")], spark) == 0
    row = spark.read.json(str(tmp_path / "r" / "results")).first()
    assert (row.total, row.accuracy, row.f1_macro, len(row.categories)) == (150, 1.0, 1.0, 8)
    assert "".join(f"{x.value}\n" for x in spark.read.text(str(tmp_path / "r" / "report")).collect()) == capsys.readouterr().out


def parsed(spark, *texts):
    return statements.parse(graphs_io.inline(spark, list(texts))).orderBy("pos").collect()


def test_statements(spark):
    a, b = parsed(spark, "The meeting started at 10:00. It lasted for 90 minutes.")
    assert (a.bound_type, b.bound_type, a.source, b.source, b.bound_us) == ("start", "duration", "The meeting", "The meeting", 5400 * 10**6)
    (r,) = parsed(spark, "Task A happened at the same time as Task B.")
    assert (r.statement_type, r.rel, r.source, r.target) == ("RELATION", 0, "Task A", "Task B")
    assert [p.statement_type for p in parsed(spark, "The race took 90 minutes")] == ["UNPARSED"]
    assert [p.bound_type for p in parsed(spark, "A happened two days before B")] == ["start"]
    assert parsed(spark, "   ... ;;; \n\n  ") == [] and parsed(spark, "") == []


def relation(session, a, b):
    return session.query(a, b)


def test_session_answers(spark):
    s = TemporalSession(spark)
    s.add_statement("A before B. B before C.")
    assert (s.query("A", "C"), s.query("C", "A"), s.query("A", "nobody")) == ("before", "after", None)
    assert "Transitivity" in s.explain("A", "C") and s.is_consistent()
    s.reset()
    s.add_statement("M before N.")
    s.add_statement("N before M.")
    assert not s.is_consistent()
    s.reset()
    s.add_relation("A", "B", "equals")
    s.add_relation("B", "C", "precedes")
    assert s.query("A", "C") == "before"
    with pytest.raises(ValueError):
        s.add_relation("A", "B", "sideways")


def events(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id bigint, event_id string, ord bigint, description string, start_time timestamp_ntz, end_time timestamp_ntz, duration_us bigint")


def edges(spark, *rows):
    return spark.createDataFrame([(1, s, t, allen.ID[r], False, 1.0, "explicit", i) for i, (s, r, t) in enumerate(rows)], "doc_id bigint, src string, tgt string, rel int, is_inferred boolean, confidence double, provenance string, ord bigint")


def named(df):
    return sorted((r.src, allen.SYMBOLIC[r.rel], r.tgt) for r in df.collect())


def test_bounds_and_validation(spark):
    h = lambda n, m=0: datetime(2026, 1, 1, n, m)
    ev = events(spark, ("a", 1, "a", h(10), None, 5400 * 10**6), ("b", 2, "b", h(12), h(13), None), ("z", 3, "z", None, h(9), 0))
    done = {r.event_id: r for r in graphs.complete_bounds(ev).collect()}
    assert done["a"].end_time == h(11, 30) and done["b"].duration_us == 3600 * 10**6 and done["z"].start_time is None
    assert named(graphs.closure(edges(spark).limit(0), allen.core_dim(spark), ev.where("event_id <> 'z'"))) == [("a", "before", "b"), ("b", "after", "a")]
    bad = events(spark, ("x", 1, "x", h(3), h(2), None), ("y", 2, "y", h(1), h(2), 1), ("w", 3, "w", None, None, -1))
    assert {(r.event_id, r.problem) for r in graphs.validation(bad).collect()} == {("x", "start_after_end"), ("y", "duration_conflict"), ("w", "negative_duration")}
    assert {(r.event_id, r.is_instantaneous, r.has_bounds) for r in graphs.flags(events(spark, ("p", 1, "p", h(1), h(1), None), ("q", 2, "q", None, None, 0))).collect()} == {("p", True, True), ("q", True, False)}


def test_single_edge_adds_its_inverse(spark):
    assert named(graphs.closure(edges(spark, ("a", "before", "b")), allen.core_dim(spark))) == [("a", "before", "b"), ("b", "after", "a")]


def brute_closure(start, table):
    known = set(start)
    while True:
        turn = {(t, r if r == 0 else ((r - 1) ^ 1) + 1, s) for s, r, t in known}
        new = turn | {(s, table[r, q], w) for s, r, t in known for u, q, w in known if t == u and s != w and (r, q) in table}
        if new <= known:
            return known
        known |= new


def test_closure_against_sets(spark):
    dim = allen.full_dim(spark)
    table = {(r.r1, r.r2): r.r3 for r in dim.collect()}
    said = [("a", "before", "b"), ("b", "equal", "c"), ("c", "contains", "d"), ("d", "overlaps", "e"), ("e", "met_by", "f"), ("f", "during", "a")]
    want = brute_closure([(s, allen.ID[r], t) for s, r, t in said], table)
    got = {(r.src, r.rel, r.tgt) for r in graphs.closure(edges(spark, *said), dim).collect()}
    assert got == want
    known: set = set()
    incremental.extend(known, [(s, t, allen.ID[r]) for s, r, t in said], table)
    assert {(s, r, t) for s, t, r in known} == want


def test_paths_and_queries(spark):
    e = edges(spark, ("a", "before", "b"), ("b", "before", "c"), ("a", "after", "d"), ("d", "before", "c"), ("x", "before", "y"))
    ask = spark.createDataFrame([(1, "a", "c"), (1, "a", "y"), (1, "d", "c")], "doc_id bigint, src string, tgt string")
    got = {(r.src, r.tgt): r.rel for r in graphs.answer(ask, e).collect()}
    assert got == {("a", "c"): 1, ("a", "y"): None, ("d", "c"): 1}


def test_paths_have_no_depth_limit(spark):
    e = edges(spark, *[(f"n{i}", "before", f"n{i + 1}") for i in range(53)])
    start = spark.createDataFrame([(1, "n0")], "doc_id bigint, origin string")
    assert {r.depth: r.node for r in graphs.paths(e, start).collect()} == {i: f"n{i}" for i in range(54)}


def test_conflicts(spark):
    cycle = edges(spark, ("a", "before", "b"), ("b", "before", "c"), ("c", "meets", "d"), ("d", "before", "a"), ("d", "before", "e"))
    assert [r.event_ids for r in graphs.cycle_paths(cycle).collect()] == [["a", "b", "c", "d", "a"]]
    assert sorted(r.node for r in graphs.cycle_nodes(cycle).collect()) == ["a", "b", "c", "d"]
    both = edges(spark, ("a", "before", "b"), ("a", "after", "b"), ("a", "before", "a"), ("b", "before", "a"))
    none = events(spark, ("a", 1, "a", None, None, None)).limit(0)
    kinds = sorted(r.conflict_type for r in graphs.conflicts(both, none).collect())
    assert kinds == ["DISJOINT_RELATIONS", "MUTUAL_BEFORE_CONFLICT", "MUTUAL_BEFORE_CONFLICT", "SELF_LOOP_CONFLICT", "STRICT_ORDER_CYCLE"]
    assert sorted(r.kind for r in graphs.direct_contradictions(both).collect()) == ["direct_relation_conflict", "self_loop_conflict"]


def test_benchmark(spark, tmp_path):
    rows = benchmark.generate(spark)
    detail = graphs.stage(evaluation.evaluate(rows))
    one = evaluation.overall(detail).first()
    assert (one.total, one.correct, one.accuracy, one.explicit_accuracy, one.inferred_accuracy, one.consistency_rate) == (150, 150, 1, 1, 1, 1)
    assert evaluation.macro(evaluation.confusion(detail)).first().f1_macro == 1
    assert {r.category: r.total for r in evaluation.by_category(detail).collect()}["durations"] == 15
    rows.coalesce(1).write.json(str(tmp_path / "b"))
    assert benchmark.read(spark, str(tmp_path / "b")).limit(1).count() == 1


def test_confusion_counts(spark):
    detail = spark.createDataFrame([("before", "before", True), ("before", "after", True), ("after", None, True), (None, "before", True), ("equal", "equal", False)], "expected string, predicted string, expected_consistent boolean")
    got = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluation.confusion(detail).collect()}
    assert got == {"before": (1, 0, 1, 1.0, 0.5), "after": (0, 1, 1, 0.0, 0.0)}


def test_cli(spark, tmp_path, capsys):
    dot = tmp_path / "g.dot"
    assert cli.main(["-s", "A before B", "-q", "B", "A", "-c", "--export-dot", str(dot)], spark) == 0
    out = capsys.readouterr().out
    assert "B -> A: after" in out and "consistent" in out and '"E1" -> "E2" [label="before", style=solid, color="black"];' in dot.read_text()
    assert cli.main(["-i", str(tmp_path / "none")], spark) == 1


def test_models(spark):
    class Fussy:
        def complete(self, prompt):
            return 'Sure: {"nodes": []}' if "could not be used" in prompt else "no json"

    rows = spark.createDataFrame([("p1",)], "prompt string")
    got = models.complete(rows, Fussy(), ["nodes"]).first()
    assert (got.reply, got.tries) == ('{"nodes": []}', 2)
    calls = spark.createDataFrame([(1, 1), (1, 2)], "run_id int, call_no int")
    replies = spark.createDataFrame([(1, 1, "{}")], "run_id int, call_no int, reply string")
    assert models.recorded(calls, replies).where("call_no = 1").first().reply == "{}"
    with pytest.raises(Exception, match="no recorded reply"):
        models.recorded(calls, replies).collect()
