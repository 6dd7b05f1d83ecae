"""Event graphs: upserts, inference to a fixpoint, paths, queries and contradictions.

Every table carries doc_id, so one plan handles any number of graphs and every join and aggregate is keyed by document.

events: doc_id, event_id, ord, description, start_time, end_time (TIMESTAMP_NTZ), duration_us
edges:  doc_id, src, tgt, rel, is_inferred, confidence, provenance, ord
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import allen
from chronoweave.plans.staging import stage

EDGE = ["doc_id", "src", "tgt", "rel", "is_inferred", "confidence", "provenance", "ord"]
KEY = ["doc_id", "src", "tgt", "rel"]
#: Inferred edges are numbered behind explicit ones: round times this, plus their rank in the round.
ROUND = 1 << 40


def microseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_microseconds(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def edge(rel: Column, src: Column, tgt: Column, provenance: Column, ord_: Column, inferred: bool = True, confidence: Column | None = None) -> list[Column]:
    return [src.alias("src"), tgt.alias("tgt"), rel.alias("rel"), F.lit(inferred).alias("is_inferred"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"), provenance.alias("provenance"), ord_.alias("ord")]


def first_edges(edges: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Of edges with the same key the one that came first."""
    rest = [c for c in EDGE if c not in by and c != "ord"]
    kept = edges.groupBy(*by).agg(F.min(F.struct("ord", *rest)).alias("e"))
    return kept.select(*[F.col(c) if c in by else F.col(f"e.{c}") for c in EDGE])


def complete_bounds(events: DataFrame) -> DataFrame:
    """Fill the third of start, end and duration where two are known; a zero duration tells nothing."""
    s, e, d = microseconds(F.col("start_time")), microseconds(F.col("end_time")), F.nullif(F.col("duration_us"), F.lit(0))
    return events.withColumns({
        "start_time": F.coalesce("start_time", from_microseconds(e - d)),
        "end_time": F.coalesce("end_time", from_microseconds(s + d)),
        "duration_us": F.coalesce(d, e - s, F.col("duration_us")),
    })


def validation(events: DataFrame) -> DataFrame:
    """One row for each broken rule of an event: doc_id, event_id, problem."""
    span = microseconds(F.col("end_time")) - microseconds(F.col("start_time"))
    rules = F.array_compact(F.array(
        F.when(span < 0, "start_after_end"),
        F.when((span >= 0) & (F.abs(span - F.col("duration_us")) > 1000), "duration_conflict"),
        F.when(F.col("duration_us") < 0, "negative_duration"),
    ))
    return events.select("doc_id", "event_id", F.explode(rules).alias("problem"))


def flags(events: DataFrame) -> DataFrame:
    """is_instantaneous and has_bounds of each event."""
    instant = (F.col("start_time") == F.col("end_time")) | (F.col("duration_us") == 0)
    bounds = F.col("start_time").isNotNull() | F.col("end_time").isNotNull() | (F.col("duration_us") != 0)
    return events.select("doc_id", "event_id", F.coalesce(instant, F.lit(False)).alias("is_instantaneous"), F.coalesce(bounds, F.lit(False)).alias("has_bounds"))


def bound_edges(events: DataFrame) -> DataFrame:
    """Edges that the times of two events of a document imply; unordered pairs are looked at once, by ord.

    Where events has since and until, a row is the state of an event in these epochs; only states of a common one are paired.
    """
    span = [c for c in ("since", "until") if c in events.columns]
    cols = ["event_id", "ord", "start_time", "end_time", "description", *span]
    a = events.select("doc_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = events.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    found = allen.partial_relation(F.col("a_start_time"), F.col("a_end_time"), F.col("b_start_time"), F.col("b_end_time"))
    pairs = a.join(b, "doc_id").where(F.col("a_ord") < F.col("b_ord"))
    if span:
        pairs = pairs.where("(b_until IS NULL OR a_since < b_until) AND (a_until IS NULL OR b_since < a_until)")
    pairs = pairs.withColumn("found", found).where(F.col("found.rel").isNotNull())
    flipped = F.col("found.flipped")
    src, tgt = F.when(flipped, F.col("b_event_id")).otherwise(F.col("a_event_id")), F.when(flipped, F.col("a_event_id")).otherwise(F.col("b_event_id"))
    said = F.concat_ws(" ", F.lit("Bounds:"), "a_description", allen.label(F.col("found.rel")), "b_description")
    return pairs.select("doc_id", *edge(F.col("found.rel"), src, tgt, said, F.shiftleft(F.col("a_ord").cast("long"), 31) + F.col("b_ord")))


def inverse_edges(edges: DataFrame) -> DataFrame:
    """The inverse of every edge that isn't there yet."""
    said = F.format_string("Inverse of (%s %s %s)", "src", allen.label(F.col("rel")), "tgt")
    turned = edges.select("doc_id", *edge(allen.inverse(F.col("rel")), F.col("tgt"), F.col("src"), said, F.col("ord"), confidence=F.col("confidence")))
    return first_edges(turned.join(edges.select(*KEY), KEY, "left_anti"))


def composed_edges(left: DataFrame, right: DataFrame, dim: DataFrame) -> DataFrame:
    """Edges u-w from left u-v and right v-w whose composition is a single relation of dim (r1, r2, r3)."""
    a = left.select("doc_id", F.col("src").alias("u"), F.col("tgt").alias("v"), F.col("rel").alias("r1"), F.col("confidence").alias("c1"), F.col("ord").alias("o1"))
    b = right.select("doc_id", F.col("src").alias("v"), F.col("tgt").alias("w"), F.col("rel").alias("r2"), F.col("confidence").alias("c2"), F.col("ord").alias("o2"))
    hops = a.join(b, ["doc_id", "v"]).where("u <> w").join(F.broadcast(dim), ["r1", "r2"])
    said = F.format_string("Transitivity: (%s %s %s) and (%s %s %s)", "u", allen.label(F.col("r1")), "v", "v", allen.label(F.col("r2")), "w")
    return first_edges(hops.select("doc_id", *edge(F.col("r3"), F.col("u"), F.col("w"), said, F.struct(F.greatest("o1", "o2").alias("most"), "o1", "o2"), confidence=F.least("c1", "c2"))))


def ranked(edges: DataFrame, round_: int, by: list) -> DataFrame:
    """edges with ord in the order of by within their document, behind those of all rounds before."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*by, "src", "tgt", "rel"))
    return edges.withColumn("ord", F.lit(round_ * ROUND) + nth).select(*EDGE)


def closure(edges: DataFrame, dim: DataFrame, events: DataFrame | None = None, inverses: bool = True, transitive: bool = True, intervals: bool = True, max_rounds: int | None = None) -> DataFrame:
    """All edges that follow from edges and the events' times, with the first provenance found.

    Semi-naive: each round turns and composes only the edges that the round before it added, and only these are written.
    Inferred edges are numbered by round, then by the numbers of the edges that they come from; inversion goes first. With
    max_rounds, a closure that isn't complete after so many raises.
    """
    start = edges.select(*EDGE)
    implied = start.where("is_inferred")
    if events is not None and intervals:
        implied = implied.unionByName(bound_edges(complete_bounds(events)).select(*EDGE))
    start = first_edges(start.where("NOT is_inferred").unionByName(ranked(implied, 1, ["ord"])))
    new, old, n = stage(start, "edges"), None, 1
    while True:
        known = new if old is None else old.unionByName(new)
        n += 1
        found = []
        if inverses:
            found.append(inverse_edges(new).withColumn("ord", F.struct(F.lit(0).alias("kind"), F.col("ord").alias("most"), F.col("ord").alias("o1"), F.lit(0).cast("long").alias("o2"))))
        if transitive:
            sides = [(new, known)] if old is None else [(new, known), (old, new)]
            for left, right in sides:
                made = composed_edges(left, right, dim)
                found.append(made.withColumn("ord", F.struct(F.lit(1).alias("kind"), F.col("ord.most").alias("most"), F.col("ord.o1").alias("o1"), F.col("ord.o2").alias("o2"))))
        if not found:
            return known
        more = found[0]
        for f in found[1:]:
            more = more.unionByName(f)
        fresh = first_edges(more.join(known.select(*KEY), KEY, "left_anti"))
        old, new = known, stage(ranked(fresh, n, ["ord"]), "edges")
        if new.isEmpty():
            return known
        if max_rounds is not None and n > max_rounds:
            raise ValueError(f"the closure isn't complete after {max_rounds} rounds")


def primary(edges: DataFrame) -> DataFrame:
    """The relation to report for an ordered pair: an explicit edge before inferred ones, the first of each."""
    best = edges.groupBy("doc_id", "src", "tgt").agg(F.min(F.struct("is_inferred", "ord", "rel")).alias("e"), F.min(F.struct("ord", "provenance")).alias("p"))
    return best.select("doc_id", "src", "tgt", F.col("e.rel").alias("rel"), F.col("e.is_inferred").alias("is_inferred"), F.col("p.provenance").alias("provenance"))


def paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Breadth-first paths from sources (doc_id, origin): doc_id, origin, node, depth, rels of the first edge of each hop.

    Among the shortest paths the one whose hops were added first wins; a frontier join advances all origins at once.
    """
    hops = stage(edges.groupBy("doc_id", F.col("src").alias("node"), F.col("tgt").alias("next")).agg(F.min(F.struct("ord", "rel")).alias("e")), "hops")
    at = stage(sources.select("doc_id", "origin", F.col("origin").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("trail"), F.array().cast("array<int>").alias("rels")), "reached")
    reached = at
    depth = 0
    while True:
        depth += 1
        step = at.join(hops, ["doc_id", "node"]).select("doc_id", "origin", F.col("next").alias("node"), F.concat("trail", F.array(F.col("e.ord").cast("long"))).alias("trail"), F.concat("rels", F.array(F.col("e.rel"))).alias("rels"))
        step = step.join(reached.select("doc_id", "origin", "node"), ["doc_id", "origin", "node"], "left_anti")
        step = step.groupBy("doc_id", "origin", "node").agg(F.min(F.struct("trail", "rels")).alias("p"))
        at = stage(step.select("doc_id", "origin", "node", F.lit(depth).alias("depth"), "p.trail", "p.rels"), "reached")
        if at.isEmpty():
            break
        reached = reached.unionByName(at)
    return reached.drop("trail")


def answer(queries: DataFrame, edges: DataFrame, walk: bool = True) -> DataFrame:
    """queries (doc_id, src, tgt) with rel, is_inferred and provenance; a path of one kind of order answers last."""
    got = queries.join(primary(edges), ["doc_id", "src", "tgt"], "left")
    if not walk:
        return got
    way = paths(edges, queries.select("doc_id", F.col("src").alias("origin")).distinct())
    same = lambda name: F.forall("rels", lambda r: r == allen.ID[name])
    way = way.where("depth > 0").select("doc_id", F.col("origin").alias("src"), F.col("node").alias("tgt"), F.when(same("before"), allen.ID["before"]).when(same("after"), allen.ID["after"]).alias("_by_path"))
    got = got.join(way, ["doc_id", "src", "tgt"], "left")
    return got.withColumn("rel", F.coalesce("rel", "_by_path")).withColumn("is_inferred", F.coalesce("is_inferred", F.lit(True))).drop("_by_path")


def _name(rel: str) -> Column:
    return F.lit(allen.ID[rel])


def timestamp_inversions(events: DataFrame) -> DataFrame:
    return events.where(F.col("start_time") > F.col("end_time")).select("doc_id", F.lit("TIMESTAMP_INVERSION").alias("conflict_type"), F.array("event_id").alias("event_ids"))


def self_loops(edges: DataFrame) -> DataFrame:
    bad = edges.where((F.col("src") == F.col("tgt")) & F.col("rel").isin([allen.ID[r] for r in ("before", "after", "meets")]))
    return bad.select("doc_id", F.lit("SELF_LOOP_CONFLICT").alias("conflict_type"), F.array("src").alias("event_ids"), "rel")


def disjoint_relations(edges: DataFrame) -> DataFrame:
    """Ordered pairs with two relations that exclude each other: also rel and rel2. Masks make it one aggregate."""
    masks = edges.where("src <> tgt").groupBy("doc_id", "src", "tgt").agg(F.bit_or(allen.bit(F.col("rel"))).alias("mask"))
    pairs = F.array(*[F.struct(_name(a).alias("rel"), _name(b).alias("rel2")) for a, b in allen.DISJOINT])
    has = lambda r: F.col("mask").bitwiseAND(allen.bit(r)) != 0
    found = masks.select("doc_id", "src", "tgt", "mask", F.explode(pairs).alias("p")).where(has(F.col("p.rel")) & has(F.col("p.rel2")))
    return found.select("doc_id", F.lit("DISJOINT_RELATIONS").alias("conflict_type"), F.array("src", "tgt").alias("event_ids"), "p.rel", "p.rel2")


def mutual_before(edges: DataFrame) -> DataFrame:
    ahead = edges.where((F.col("rel") == _name("before")) & (F.col("src") != F.col("tgt"))).select("doc_id", "src", "tgt").distinct()
    back = ahead.select("doc_id", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    both = ahead.join(back, ["doc_id", "src", "tgt"], "left_semi")
    return both.select("doc_id", F.lit("MUTUAL_BEFORE_CONFLICT").alias("conflict_type"), F.array("src", "tgt").alias("event_ids"))


def mismatches(edges: DataFrame, events: DataFrame) -> DataFrame:
    ends = lambda side: events.select("doc_id", F.col("event_id").alias(side), F.col("start_time").alias(f"{side}_start"), F.col("end_time").alias(f"{side}_end"))
    said = edges.where(F.col("rel") == _name("before")).join(ends("src"), ["doc_id", "src"]).join(ends("tgt"), ["doc_id", "tgt"])
    bad = said.where(F.col("src_start") >= F.col("tgt_end"))
    return bad.select("doc_id", F.lit("RELATION_TIMESTAMP_MISMATCH").alias("conflict_type"), F.array("src", "tgt").alias("event_ids"))


def strict(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("rel").isin(allen.ID["before"], allen.ID["meets"]))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Events on a cycle of strict order: doc_id, node. Reachability doubles in each round, until nothing more is reached."""
    reach = stage(strict(edges).select("doc_id", "src", "tgt").distinct(), "reach")
    n = reach.count()
    while True:
        further = reach.join(reach.select("doc_id", F.col("src").alias("tgt"), F.col("tgt").alias("far")), ["doc_id", "tgt"]).select("doc_id", "src", F.col("far").alias("tgt"))
        reach = stage(reach.unionByName(further).distinct(), "reach")
        n, before = reach.count(), n
        if n == before:
            return reach.where("src = tgt").select("doc_id", F.col("src").alias("node"))


def cycle_paths(edges: DataFrame) -> DataFrame:
    """One cycle of strict order a document, as the nodes that close it: depth first in the order of the edges."""

    def find(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("ord")
        follow: dict[str, list[str]] = {}
        for s, t in zip(table["src"], table["tgt"]):
            follow.setdefault(s, []).append(t)
        done: set[str] = set()
        for root in list(follow):
            path, todo = [], [(root, iter(follow.get(root, ())))]
            if root in done:
                continue
            path.append(root)
            while todo:
                node, rest = todo[-1]
                nxt = next(rest, None)
                if nxt is None:
                    todo.pop()
                    done.add(path.pop())
                elif nxt in path:
                    return pd.DataFrame({"doc_id": table["doc_id"].iloc[:1].tolist(), "event_ids": [path[path.index(nxt) :] + [nxt]]})
                elif nxt not in done:
                    path.append(nxt)
                    todo.append((nxt, iter(follow.get(nxt, ()))))
        return pd.DataFrame({"doc_id": table["doc_id"].iloc[:0], "event_ids": pd.Series([], dtype=object)})

    some = strict(edges).select("doc_id", "src", "tgt", "ord")
    kind = some.schema["doc_id"].dataType.simpleString()
    got = some.groupBy("doc_id").applyInPandas(find, f"doc_id {kind}, event_ids array<string>")
    return got.select("doc_id", F.lit("STRICT_ORDER_CYCLE").alias("conflict_type"), "event_ids")


def conflicts(edges: DataFrame, events: DataFrame) -> DataFrame:
    """All contradictions: doc_id, conflict_type, event_ids, message; equal messages once a document."""
    cols = ["doc_id", "conflict_type", "event_ids", "detail"]
    name = lambda c: allen.label(F.col(c))
    found = [
        timestamp_inversions(events).withColumn("detail", F.lit("start after end")),
        self_loops(edges).withColumn("detail", name("rel")),
        disjoint_relations(edges).withColumn("detail", F.concat_ws(" and ", name("rel"), name("rel2"))),
        mutual_before(edges).withColumn("detail", F.lit("each before the other")),
        cycle_paths(edges).withColumn("detail", F.lit("cycle")),
        mismatches(edges, events).withColumn("detail", F.lit("before, but starts after its end")),
    ]
    every = found[0].select(*cols)
    for f in found[1:]:
        every = every.unionByName(f.select(*cols))
    message = F.concat_ws(" ", "conflict_type", F.concat(F.lit("("), F.array_join("event_ids", " -> "), F.lit("):")), "detail")
    return every.withColumn("message", message).drop("detail").dropDuplicates(["doc_id", "message"])


def direct_contradictions(edges: DataFrame) -> DataFrame:
    """Self loops of before or after, and pairs with both: doc_id, kind, src, tgt."""
    order = edges.where(F.col("rel").isin(allen.ID["before"], allen.ID["after"]))
    loops = order.where("src = tgt").select("doc_id", F.lit("self_loop_conflict").alias("kind"), "src", "tgt")
    both = order.groupBy("doc_id", "src", "tgt").agg(F.bit_or(allen.bit(F.col("rel"))).alias("mask")).where(F.bit_count("mask") == 2)
    return loops.unionByName(both.select("doc_id", F.lit("direct_relation_conflict").alias("kind"), "src", "tgt"))


def resolve(names: DataFrame, events: DataFrame) -> DataFrame:
    """names (doc_id, item) with event_id: an id, else the last event of that description, else the item itself."""
    by_name = events.groupBy("doc_id", F.lower(F.trim("description")).alias("_key")).agg(F.max_by("event_id", "ord").alias("_by_name"))
    got = names.join(events.select("doc_id", F.col("event_id").alias("item"), F.col("event_id").alias("_id")), ["doc_id", "item"], "left")
    got = got.withColumn("_key", F.lower(F.trim("item"))).join(by_name, ["doc_id", "_key"], "left")
    return got.select("doc_id", "item", F.coalesce("_id", "_by_name", "item").alias("event_id"))
