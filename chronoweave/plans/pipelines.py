"""Whole narrative pipelines: from extracted graphs to repaired orders and scores, and from specs to dataset variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import allen
from chronoweave.operators import narrative, stories
from chronoweave.sources import models
from chronoweave.sources import stories as source
from chronoweave.sources.stories import REPLIES

from .staging import stage


def finish(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, repairs: bool = True, tie_break: str = "earliest") -> dict[str, DataFrame]:
    """Repair, order, verify, merge: edges, log (of repairs) and stories (thread_orders, convergence, log, global_order)."""
    known = narrative.known_edges(edges, nodes)
    fixed, log = narrative.repair(known) if repairs else (known, None)
    done = stage(narrative.finish(narrative.as_stories(nodes, fixed, candidates), tie_break), "stories")
    return {"edges": fixed, "repair_log": log, "stories": done}


def order_of(finished: DataFrame) -> DataFrame:
    return finished.select("story_id", F.posexplode("global_order").alias("position", "id"))


def pairs_of(finished: DataFrame) -> DataFrame:
    return finished.select("story_id", F.posexplode("convergence").alias("ord", "p")).select("story_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "ord")


def extract(passages: DataFrame, model: models.Model, prompts: dict[str, str], critique: bool = False) -> dict[str, DataFrame]:
    """Nodes, edges and candidate groups that a model reads from passages (story_id, passage); critique asks once more
    for what was missed. Each prompt is a text with {passage} and, from the second call on, {so_far}."""

    def ask(kind, schema, so_far=None):
        rows = passages if so_far is None else passages.join(so_far, "story_id")
        text = F.replace(F.lit(prompts[kind]), F.lit("{passage}"), F.col("passage"))
        rows = rows.select("story_id", (text if so_far is None else F.replace(text, F.lit("{so_far}"), F.col("so_far"))).alias("prompt"))
        required = [part.split()[0] for part in schema.split(", ") if part[0].isalpha() and " " in part and "<" in part or part.startswith("global_order")]
        got = models.complete(rows, model, [r for r in required if r in ("nodes", "edges", "events", "global_order")])
        return stage(got.select("story_id", "reply", F.from_json("reply", schema).alias("r")), kind)

    node = ask("node", REPLIES["node"])
    edge = ask("edge", REPLIES["edge"], node.select("story_id", F.col("reply").alias("so_far")))
    groups = edge.select("story_id", F.posexplode("r.convergence_points").alias("ord", "g")).select("story_id", F.col("ord").cast("long").alias("ord"), "g.members")
    if critique:
        more = ask("critique", REPLIES["edge"], edge.select("story_id", F.col("reply").alias("so_far")))
        missed = more.select("story_id", F.posexplode("r.convergence_points").alias("ord", "g")).select("story_id", F.col("ord").cast("long").alias("ord"), "g.members")
        groups = narrative.merge_groups(groups, missed).select("story_id", (F.col("pass") * 100000 + F.col("ord")).alias("ord"), "members")
    at = groups.select("story_id", "ord", "members", F.posexplode("members").alias("i", "a"))
    pairs = at.select("story_id", (F.col("ord") * 1000 + F.col("i")).alias("ord"), "a", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("b"))
    edges = edge.select("story_id", F.posexplode("r.edges").alias("ord", "e")).select("story_id", F.col("ord").cast("long").alias("ord"), "e.node_i", "e.node_j", F.col("e.allen_relation").alias("label"))
    return {"nodes": node.select("story_id", F.explode("r.nodes").alias("n")).select("story_id", "n.*"), "edges": edges, "candidates": pairs}


def ablation(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, missed: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """Both arms on one shared extraction: without and with the candidates that the critique added."""
    shared = [stage(df) for df in (nodes, edges, candidates)]
    return {"base": finish(*shared), "critique": finish(shared[0], shared[1], shared[2].unionByName(missed))}


def rescore(gold: dict[str, DataFrame], predicted: dict[str, DataFrame], recompute: bool = False, tie_break: str = "earliest") -> DataFrame:
    """Scores of stored predictions, from tables as chronoweave.sources.stories.tables gives them. recompute also runs
    ordering and verification again instead of reading their stored results."""
    order, pairs = predicted.get("order"), predicted["pairs"]
    if recompute:
        done = finish(predicted["events"], predicted["edges"], predicted["candidates"], tie_break=tie_break)["stories"]
        order, pairs = order_of(done), pairs_of(done)
    pool = gold.get("pool", gold["pairs"].limit(0))
    return narrative.score_record(gold["events"], predicted["events"], gold["edges"], predicted["edges"], order, gold["pairs"], pairs, pool)


def direct(replies: DataFrame) -> dict[str, DataFrame]:
    """Tables of one-call replies (story_id, reply); their edges come from the order alone when scored."""
    r = stage(replies.select("story_id", F.from_json("reply", REPLIES["direct"]).alias("r")), "direct")
    one = lambda c: stories.normalized_id(F.col(c))
    events = r.select("story_id", F.explode("r.events").alias("e")).select("story_id", one("e.id").alias("id"), "e.thread_id")
    order = r.select("story_id", F.posexplode("r.global_order").alias("position", "x")).select("story_id", one("x").alias("id"), "position")
    pairs = r.select("story_id", F.posexplode("r.convergence_points").alias("ord", "p")).select("story_id", stories.normalized_id(F.col("p")[0]).alias("a"), stories.normalized_id(F.col("p")[1]).alias("b"), "ord")
    none = events.limit(0).select("story_id", F.col("id").alias("node_i"), F.col("id").alias("node_j"), F.lit(0).alias("rel"), F.lit(0).cast("long").alias("ord"))
    return {"events": events, "order": order, "pairs": pairs, "edges": none}


def log_counts(repair_log: DataFrame) -> DataFrame:
    """story_id, repairs, conflicts: edges that were changed, and those that contradict but were left."""
    return repair_log.groupBy("story_id").agg(F.count("to_rel").alias("repairs"), F.count_if(F.col("to_rel").isNull()).alias("conflicts"))


def predict(gold: dict[str, DataFrame], model: models.Model, prompts: dict[str, str] | None = None, critique: bool = False) -> tuple[DataFrame, DataFrame]:
    """Extract, finish and score all stories of gold (tables of stories): (predictions to store, summary).

    A prediction is one nested row a story, as read_predictions reads it. The summary has the scores, those of the raw
    edges and candidates, awt_f1_delta between the two, repairs and conflicts.
    """
    read = extract(stories.passage(gold["events"]), model, prompts or models.PROMPTS, critique)
    done = finish(read["nodes"], read["edges"], read["candidates"])
    finished, order = done["stories"], order_of(done["stories"])
    pool = gold.get("pool", gold["pairs"].limit(0))
    raw = narrative.known_edges(read["edges"], read["nodes"])
    against = lambda edges, pairs: narrative.score_record(gold["events"], read["nodes"], gold["edges"], edges, order, gold["pairs"], pairs, pool)
    after = stage(against(done["edges"], pairs_of(finished)), "scores")
    before = stage(against(raw, read["candidates"]), "scores")
    both = after.join(before.select("story_id", F.col("awt_f1").alias("awt_f1_unrepaired"), F.col("relation_score").alias("relation_score_unrepaired")), "story_id")
    summary = both.withColumn("awt_f1_delta", F.col("awt_f1") - F.col("awt_f1_unrepaired")).join(log_counts(done["repair_log"]), "story_id", "left").fillna(0, ["repairs", "conflicts"])
    nested = lambda df, name, *cols: df.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    labelled = lambda df: df.withColumn("allen_relation", allen.label(F.col("rel"), allen.RELATIONS))
    scores = after.select("story_id", F.struct("relation_score", F.col("thread_accuracy").alias("thread_attribution_accuracy"), "awt_core", "convergence_f1", F.col("precision_vs_pool").alias("convergence_precision_vs_pool"), F.col("recall_salient").alias("convergence_recall_salient")).alias("awt_f1_scores"))
    rows = finished.select("story_id", "thread_orders", "global_order", F.col("convergence").alias("convergence_points"))
    for part in (nested(read["nodes"], "events", "id", "thread_id"), nested(labelled(done["edges"]), "edges", "ord", "node_i", "node_j", "allen_relation"), nested(labelled(raw), "raw_edges", "ord", "node_i", "node_j", "allen_relation"), scores):
        rows = rows.join(part, "story_id", "left")
    return rows, summary


def rescore_stored(gold: dict[str, DataFrame], predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions with new awt_f1_scores, dir and both scores) of stored predictions of the stories of gold.

    Use sources.stories.replace to put the first in the place of what was read.
    """
    held = stage(predictions.where("awt_f1_scores IS NOT NULL"), "stored")
    scored = rescore(gold, source.tables(held.drop("candidate_convergence_pairs") if "candidate_convergence_pairs" in held.columns else held))
    new = scored.select(F.col("story_id").alias("_dir"), F.struct("relation_score", F.col("thread_accuracy").alias("thread_attribution_accuracy"), "awt_core", "convergence_f1", F.col("precision_vs_pool").alias("convergence_precision_vs_pool"), F.col("recall_salient").alias("convergence_recall_salient")).alias("_new"))
    both = stage(held.join(new, F.col("dir") == F.col("_dir"), "left"), "rescored")
    deltas = both.select("dir", F.col("awt_f1_scores.relation_score").alias("before"), F.col("_new.relation_score").alias("after"))
    return both.withColumn("awt_f1_scores", F.coalesce("_new", "awt_f1_scores")).drop("_new", "_dir"), deltas


def pooled_report(gold_pairs: DataFrame, predicted_pairs: DataFrame) -> DataFrame:
    """condition, story_id (null for all pooled), precision, recall, f1 of predicted pairs (condition, story_id, a, b)."""
    keyed = lambda df: df.select(F.concat_ws("\x1f", "condition", "story_id").alias("story_id"), "a", "b")
    conditions = predicted_pairs.select("condition").distinct()
    gold = gold_pairs.crossJoin(F.broadcast(conditions))  # a handful of conditions
    keys = keyed(gold).select("story_id").union(keyed(predicted_pairs).select("story_id")).distinct()
    each = narrative.set_scores(keyed(gold), keyed(predicted_pairs), keys)
    part = lambda i: F.element_at(F.split("story_id", "\x1f"), i)
    by_story = each.select(part(1).alias("condition"), part(2).alias("story_id"), "precision", "recall", "f1", "n_gold", "n_predicted")
    hits = by_story.withColumn("h", F.round(F.col("recall") * F.col("n_gold"))).groupBy("condition").agg(F.sum("h").alias("h"), F.sum("n_gold").alias("n_gold"), F.sum("n_predicted").alias("n_predicted"))
    share = lambda n: F.when((F.col("n_gold") == 0) & (F.col("n_predicted") == 0), 1.0).when((F.col("n_gold") == 0) | (F.col("n_predicted") == 0), 0.0).otherwise(F.col("h") / F.col(n))
    pooled = hits.withColumns({"precision": share("n_predicted"), "recall": share("n_gold")})
    pooled = pooled.select("condition", F.lit(None).cast("string").alias("story_id"), "precision", "recall", narrative.f1(F.col("precision"), F.col("recall")).alias("f1"), "n_gold", "n_predicted")
    return by_story.unionByName(pooled)


def build(events: DataFrame, links: DataFrame, names: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """From interval specs: gold edges, pool, and events with their counterfactual texts."""
    twins = events.withColumn("cf_text", stories.rename(F.col("text"), names))
    return {"events": twins, "edges": stories.gold_edges(links, events), "pool": stories.convergence_pool(events)}


def linearize(events: DataFrame, edges: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The same story with ids in chronological order, and the map from old to new ids."""
    nested = narrative.as_stories(events, edges, pairs)
    ordered = stage(narrative.finish(nested).select("story_id", "thread_orders"), "orders")
    anchors = nested.select("story_id", "candidates").join(ordered, "story_id")

    def merged(parts):
        for table in parts:
            table["global_order"] = [narrative.merge({t: [*o] for t, o in dict(orders).items()}, [[*p] for p in cand]) for orders, cand in zip(table["thread_orders"], table["candidates"])]
            yield table[["story_id", "global_order"]]

    kind = nested.schema["story_id"].dataType.simpleString()
    ids = stage(stories.linear_ids(anchors.mapInPandas(merged, f"story_id {kind}, global_order array<string>")), "ids")
    new = stories.relabel(ids, events, edges, pairs)
    return dict(zip(("events", "edges", "pairs"), new)) | {"ids": ids}


def is_permutation(ids: DataFrame, events: DataFrame) -> bool:
    """Whether the linear ids cover each event exactly once."""
    old, now = ids.select("story_id", F.col("old").alias("id")), events.select("story_id", "id")
    return old.exceptAll(now).isEmpty() and now.exceptAll(old).isEmpty()


