"""Building, splitting and auditing narrative datasets.

Tables: threads (story_id, id, label), events (story_id, id, thread_id, text, start, end), links (story_id, node_i,
node_j, ord), pairs (story_id, a, b). Every audit gives one row for each violation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import allen

from . import narrative

OPENING = 4
#: Limits of a valid story, thresholds of a leak, words that are no names.
THREADS, PER_THREAD, CROSS = (3, 6), (9, 12), (3, 7)
NAME_OPENING, BASELINE = 0.40, 0.85
TITLES = ("The", "A", "An", "Inspector", "Nurse", "Dr", "Doctor", "Pharmacist", "Dispatcher", "Clerk", "Mrs", "Mr", "Ms", "Sergeant", "Detective", "Officer", "Captain", "Professor")


def number(id_: Column) -> Column:
    """The number behind an id's first letter."""
    return F.substring(id_, 2, 20).try_cast("int")


def normalized_id(id_: Column) -> Column:
    return F.when(id_.startswith("s"), id_).otherwise(F.concat(F.lit("s"), id_))


def passage(events: DataFrame) -> DataFrame:
    """story_id, passage: the numbered sentences of a story in the order of their ids."""
    line = F.struct(number(F.col("id")).alias("n"), F.col("id"), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["text"]))
    return events.groupBy("story_id").agg(F.array_join(lines, "\n").alias("passage"))


def _ends(links: DataFrame, events: DataFrame, *cols: str) -> DataFrame:
    side = lambda node, s: events.select("story_id", F.col("id").alias(node), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return links.join(side("node_i", "i"), ["story_id", "node_i"]).join(side("node_j", "j"), ["story_id", "node_j"])


def gold_edges(links: DataFrame, events: DataFrame) -> DataFrame:
    """links with the relation of their ends' intervals; null for degenerate ones."""
    rel = allen.proper_relation(*[F.col(c) for c in ("start_i", "end_i", "start_j", "end_j")])
    return _ends(links, events, "start", "end").select("story_id", "node_i", "node_j", "ord", rel.alias("rel"))


def shared_instants(events: DataFrame) -> DataFrame:
    """Pairs of events of two threads with a common boundary, by equality of single instants instead of a disjunction."""
    ends = events.select("story_id", "id", "thread_id", "start", "end", F.explode(F.array_distinct(F.array("start", "end"))).alias("instant"))
    cols = lambda s: ends.select("story_id", "instant", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "thread_id", "start", "end")])
    both = cols("a").join(cols("b"), ["story_id", "instant"]).where("id_a < id_b AND thread_id_a <> thread_id_b")
    return both.drop("instant").distinct()


def convergence_pool(events: DataFrame) -> DataFrame:
    """Pairs that truly share an instant: shared_instants without pairs that both begin or both end with the story."""
    frame = events.groupBy("story_id").agg(F.min("start").alias("_from"), F.max("end").alias("_to"))
    rows = shared_instants(events).join(frame, "story_id")
    both = lambda c, at: (F.col(f"{c}_a") == F.col(at)) & (F.col(f"{c}_b") == F.col(at))
    return rows.where(~both("start", "_from") & ~both("end", "_to")).select("story_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def thread_counts(threads: DataFrame, events: DataFrame) -> DataFrame:
    """Events of every declared thread, none included."""
    n = events.groupBy("story_id", F.col("thread_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return threads.select("story_id", "id").join(n, ["story_id", "id"], "left").select("story_id", F.col("id").alias("thread_id"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_events"))


def cross_counts(links: DataFrame, events: DataFrame) -> DataFrame:
    return _ends(links, events, "thread_id").groupBy("story_id").agg(F.count_if(F.col("thread_id_i") != F.col("thread_id_j")).alias("n_cross"))


def problems(threads: DataFrame, events: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """story_id, problem, item: all violations of the rules for stories."""
    say = lambda df, what, item: df.select("story_id", F.lit(what).alias("problem"), item.cast("string").alias("item"))
    out = lambda c, limits: ~F.col(c).between(*limits)
    n = threads.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    undeclared = events.join(threads.select("story_id", F.col("id").alias("thread_id")), ["story_id", "thread_id"], "left_anti").select("story_id", "thread_id").distinct()
    named = pairs.withColumnsRenamed({"a": "node_i", "b": "node_j"})
    ends = _ends(named, events, "thread_id", "start", "end")
    joint = F.concat_ws("/", "node_i", "node_j")
    apart = ~F.arrays_overlap(F.array("start_i", "end_i"), F.array("start_j", "end_j"))
    found = [
        say(n.where(out("n", THREADS)), "thread_count", F.col("n")),
        say(thread_counts(threads, events).where(out("n_events", PER_THREAD)), "events_per_thread", F.concat_ws("=", "thread_id", "n_events")),
        say(undeclared, "undeclared_thread", F.col("thread_id")),
        say(events.where("start > end"), "end_before_start", F.col("id")),
        say(cross_counts(links, events).where(out("n_cross", CROSS)), "cross_thread_edges", F.col("n_cross")),
        say(ends.where("thread_id_i = thread_id_j"), "convergence_in_one_thread", joint),
        say(ends.where(apart), "convergence_without_instant", joint),
    ]
    if "label" in threads.columns and "text" in events.columns:
        first = F.filter(F.split(F.element_at(F.split("label", ","), 1), r"\s+"), lambda w: F.regexp_like(w, F.lit("^[A-Z]")))
        own = events.join(threads.select("story_id", F.col("id").alias("thread_id"), first.alias("_names")), ["story_id", "thread_id"])
        found.append(say(own.where(F.exists("_names", lambda w: F.contains(opening(F.col("text")), w))), "opens_with_own_name", F.col("id")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def coverage(edges: DataFrame) -> DataFrame:
    """relation, n, share over all 13 relations, zeros included; edges has rel."""
    dim = edges.sparkSession.createDataFrame([(i, name) for i, name in enumerate(allen.RELATIONS)], "rel int, relation string")
    got = F.broadcast(dim).join(edges.groupBy("rel").agg(F.count(F.lit(1)).alias("_n")), "rel", "left").withColumn("n", F.coalesce("_n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return got.select("relation", "n", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)).alias("share"))


def signature(events: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """story_id, signature: one hash of a story's ids, labelled edges and pairs, whatever their order."""
    rows = events.select("story_id", F.concat_ws("|", F.lit("n"), "id").alias("x")).unionByName(edges.select("story_id", F.concat_ws("|", F.lit("e"), "node_i", "node_j", "rel").alias("x"))).unionByName(pairs.select("story_id", F.concat_ws("|", F.lit("c"), F.least("a", "b"), F.greatest("a", "b")).alias("x")))
    return rows.groupBy("story_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("signature"))


def relabel(ids: DataFrame, events: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with ids mapped by ids (story_id, old, new)."""
    to = lambda df, c: df.join(ids.select("story_id", F.col("old").alias(c), F.col("new").alias("_new")), ["story_id", c]).withColumn(c, F.col("_new")).drop("_new")
    return to(events, "id"), to(to(edges, "node_i"), "node_j"), to(to(pairs, "a"), "b")


def linear_ids(order: DataFrame) -> DataFrame:
    """story_id, old, new = s1, s2, ... from order (story_id, global_order)."""
    return order.select("story_id", F.posexplode("global_order").alias("_i", "old")).select("story_id", "old", F.concat(F.lit("s"), (F.col("_i") + 1).cast("string")).alias("new"))


def isomorphic(first: tuple[DataFrame, DataFrame, DataFrame], second: tuple[DataFrame, DataFrame, DataFrame], ids: DataFrame) -> DataFrame:
    """story_id, same: whether relabelling the first story's events, edges and pairs gives the second."""
    a = signature(*relabel(ids, *first)).withColumnRenamed("signature", "_a")
    return a.join(signature(*second), "story_id", "full").select("story_id", F.coalesce(F.col("_a") == F.col("signature"), F.lit(False)).alias("same"))


def variant(authoring: DataFrame, counterfactual: bool, columns: list[str]) -> DataFrame:
    """Authoring rows of one variant: cf_<column> instead of each column, or the column where its twin is empty."""
    pick = lambda c: (F.coalesce(F.nullif(F.col(f"cf_{c}"), F.lit("")), F.col(c)) if counterfactual else F.col(c)).alias(c)
    return authoring.select(*[pick(c) if c in columns else F.col(c) for c in authoring.columns if not c.startswith("cf_")])


def rename(text: Column, names: list[tuple[str, str]]) -> Column:
    """Replacements one after another, so a later one sees what an earlier one wrote."""
    for old, new in names:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def drop_thread(events: DataFrame, edges: DataFrame, pairs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the threads in gone (story_id, thread_id): their events and all edges and pairs that touch those."""
    dead = events.join(gone, ["story_id", "thread_id"], "left_semi").select("story_id", "id")
    off = lambda df, c: df.join(dead.withColumnRenamed("id", c), ["story_id", c], "left_anti")
    return events.join(gone, ["story_id", "thread_id"], "left_anti"), off(off(edges, "node_i"), "node_j"), off(off(pairs, "a"), "b")


def update_text(events: DataFrame, changes: DataFrame) -> DataFrame:
    """events with the texts of changes (story_id, id, text) where there are any."""
    return events.join(changes.select("story_id", "id", F.col("text").alias("_new")), ["story_id", "id"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def degrade(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """edges with the labels of overrides (story_id, node_i, node_j, new_rel); a null label drops the edge."""
    got = edges.join(overrides.withColumn("_hit", F.lit(True)), ["story_id", "node_i", "node_j"], "left").where("_hit IS NULL OR new_rel IS NOT NULL")
    return got.withColumn("rel", F.coalesce("new_rel", "rel")).drop("new_rel", "_hit")


def aliases(label: Column) -> Column:
    """Capitalised words of a label's first part that aren't titles."""
    words = F.regexp_extract_all(F.element_at(F.split(label, ","), 1), F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(t) for t in TITLES]))


def opening(text: Column, n: int = OPENING) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def name_opening_rate(threads: DataFrame, events: DataFrame) -> DataFrame:
    """story_id, thread_id, rate: share of a thread's events that open with one of its names; 0 without names or events."""
    named = threads.select("story_id", F.col("id").alias("thread_id"), aliases(F.col("label")).alias("_names"))
    rows = named.join(events.select("story_id", "thread_id", opening(F.col("text")).alias("_open")), ["story_id", "thread_id"], "left")
    hit = F.exists("_names", lambda a: F.contains(F.col("_open"), a))
    return rows.groupBy("story_id", "thread_id").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("rate"))


def lexical_baseline(threads: DataFrame, events: DataFrame) -> DataFrame:
    """story_id, id, thread_id: the thread with the longest name in an event's text, the first of equal ones; null if none."""
    names = threads.select("story_id", F.col("id").alias("_thread"), F.col("ord").alias("_place"), F.explode(aliases(F.col("label"))).alias("_name"))
    hits = events.join(names, "story_id").where(F.contains("text", F.col("_name")))
    best = hits.groupBy("story_id", "id").agg(F.min(F.struct((-F.length("_name")).alias("n"), "_place", "_thread")).alias("b"))
    return events.select("story_id", "id").join(best, ["story_id", "id"], "left").select("story_id", "id", F.col("b._thread").alias("thread_id"))


def leakage(threads: DataFrame, events: DataFrame) -> DataFrame:
    """story_id, worst_rate, baseline_accuracy, leaks."""
    rates = name_opening_rate(threads, events).groupBy("story_id").agg(F.max("rate").alias("worst_rate"))
    guess = lexical_baseline(threads, events)
    accuracy = narrative.thread_accuracy(events, guess, narrative.best_mapping(narrative.contingency(events, guess)))
    leaks = (F.col("worst_rate") > NAME_OPENING) | (F.col("thread_accuracy") > BASELINE)
    return rates.join(accuracy, "story_id").select("story_id", "worst_rate", F.col("thread_accuracy").alias("baseline_accuracy"), leaks.alias("leaks"))
