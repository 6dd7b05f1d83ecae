"""Narrative graphs: path-consistency repair, thread orders, convergence and graph scores.

Relational tables carry story_id. nodes: story_id, id, thread_id; edges: story_id, node_i, node_j, rel, ord;
pairs: story_id, a, b, ord; order: story_id, id, position. A story is a bounded document, so what must walk its
events one after another (topological order, increasing subsequences, merging) runs on one nested row a story.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import allen
from chronoweave.plans.staging import stage

PASSES = 5
WITNESSES = 2


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are nodes of the story and whose label is a relation; edges has label or rel."""
    ids = lambda c: nodes.select("story_id", F.col("id").alias(c)).distinct()
    rel = allen.rel_id(F.col("label")) if "label" in edges.columns else F.col("rel")
    return edges.withColumn("rel", rel).where("rel IS NOT NULL").join(ids("node_i"), ["story_id", "node_i"], "left_semi").join(ids("node_j"), ["story_id", "node_j"], "left_semi")


def votes(edges: DataFrame, composition: DataFrame) -> DataFrame:
    """For each edge with witnesses: story_id, node_i, node_j, ord, rel, mask (common to all witnesses), n."""
    one = edges.select("story_id", F.col("node_i").alias("x"), F.col("node_j").alias("y"), F.col("rel").alias("r"), (2 * F.col("ord")).alias("o"))
    back = edges.select("story_id", F.col("node_j").alias("x"), F.col("node_i").alias("y"), allen.inverse(F.col("rel")).alias("r"), (2 * F.col("ord") + 1).alias("o"))
    both = one.unionByName(back).groupBy("story_id", "x", "y").agg(F.max_by("r", "o").alias("r"))
    to = both.select("story_id", F.col("x").alias("node_i"), F.col("y").alias("via"), F.col("r").alias("r1"))
    on = both.select("story_id", F.col("x").alias("via"), F.col("y").alias("node_j"), F.col("r").alias("r2"))
    seen = edges.join(to, ["story_id", "node_i"]).join(on, ["story_id", "via", "node_j"]).where("via <> node_i AND via <> node_j")
    seen = seen.join(F.broadcast(composition), ["r1", "r2"])
    return seen.groupBy("story_id", "node_i", "node_j", "ord", "rel").agg(F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("n"))


def decide(voted: DataFrame, distances: DataFrame) -> DataFrame:
    """Votes that contradict their edge: to_rel (null if left as it is) and reason."""
    bad = voted.where(F.col("mask").bitwiseAND(allen.bit(F.col("rel"))) == 0)
    options = F.filter(F.sequence(F.lit(0), F.lit(12)), lambda r: F.col("mask").bitwiseAND(allen.bit(r)) != 0)
    each = bad.withColumn("option", F.explode_outer(options))
    dims = distances.select(F.col("r1").alias("rel"), F.col("r2").alias("option"), "distance")
    best = each.join(F.broadcast(dims), ["rel", "option"], "left").groupBy("story_id", "node_i", "node_j", "ord", "rel", "mask", "n").agg(F.min(F.struct("distance", "option")).alias("b"))
    enough = (F.col("mask") != 0) & (F.col("n") >= WITNESSES)
    reason = F.when(enough, "repaired").when(F.col("mask") == 0, "witnesses_disagree").otherwise("too_few_witnesses")
    return best.select("story_id", "node_i", "node_j", "ord", "rel", "n", F.when(enough, F.col("b.option")).alias("to_rel"), reason.alias("reason"))


def repair(edges: DataFrame, nodes: DataFrame | None = None, max_passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(repaired edges, log). All edges of a pass are judged by the state before it; a story whose state comes again
    stops. An edge that is left as it is, is logged once."""
    spark = edges.sparkSession
    composition, distances = stage(allen.composition_dim(spark)), stage(allen.distance_dim(spark))
    current = stage((known_edges(edges, nodes) if nodes is not None else edges).select("story_id", "node_i", "node_j", "rel", "ord"))
    states, log = None, None
    for n in range(max_passes):
        now = current.groupBy("story_id").agg(F.bit_xor(F.xxhash64("node_i", "node_j", "rel", "ord")).alias("state"))
        live = now if states is None else now.join(states, ["story_id", "state"], "left_anti")
        done = stage(decide(votes(current.join(live.select("story_id"), "story_id", "left_semi"), composition), distances).withColumn("pass", F.lit(n)))
        log = done if log is None else log.unionByName(done)
        fixes = done.where("to_rel IS NOT NULL").select("story_id", "ord", "to_rel")
        if fixes.isEmpty():
            break
        states = stage(now) if states is None else states.unionByName(stage(now))
        current = stage(current.join(fixes, ["story_id", "ord"], "left").select("story_id", "node_i", "node_j", F.coalesce("to_rel", "rel").alias("rel"), "ord"))
    fixed = log.where("to_rel IS NOT NULL")
    left = log.where("to_rel IS NULL").groupBy("story_id", "node_i", "node_j").agg(F.min(F.struct("pass", "ord", "rel", "n", "to_rel", "reason")).alias("f")).select("story_id", "node_i", "node_j", "f.*")
    return current, fixed.unionByName(left, allowMissingColumns=True)


# ------------------------------------------------------------------ one story at a time


def thread_orders(nodes: list[tuple], edges: list[tuple]) -> dict[str, list[str]]:
    """Order of each thread's events by its own edges; a thread with a cycle is ordered by id.

    Events leave in the order in which their last predecessor left; the first ones go by id, and those that one event frees
    by the place of their edge.
    """
    thread = dict(nodes)
    waits, frees = dict.fromkeys(sorted(thread), 0), {n: [] for n in thread}
    for i, j, rel in edges:
        if thread.get(i, i) != thread.get(j, j) or i not in thread or j not in thread:
            continue
        way = (i, j) if allen.RELATIONS[rel] in allen.PRECEDES else (j, i) if allen.RELATIONS[rel] in allen.FOLLOWS else None
        if way:
            frees[way[0]].append(way[1])
            waits[way[1]] += 1
    out: dict[str, list[str]] = {t: [] for t in dict.fromkeys(thread.values())}
    queue = deque(n for n, k in waits.items() if not k)
    while queue:
        node = queue.popleft()
        out[thread[node]].append(node)
        for other in frees[node]:
            waits[other] -= 1
            if not waits[other]:
                queue.append(other)
    stuck = {thread[n] for n, k in waits.items() if k}
    return {t: [n for n in waits if thread[n] == t] if t in stuck else order for t, order in out.items()}


def increasing(values: list[int], tie_break: str = "earliest") -> set[int]:
    """Indices of a longest strictly increasing subsequence.

    Among several the one of the earliest candidates; with smallest_tail the one that patience sorting finds.
    """
    tails: list[int] = []  # smallest last value of a subsequence of each length
    ends: list[int] = []  # and its index
    rank, before = [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        rank.append(k)
        before.append(ends[k - 1] if k else None)
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    if tie_break == "smallest_tail":
        at, kept = (ends[-1] if ends else None), set()
        while at is not None:
            kept.add(at)
            at = before[at]
        return kept
    kept, limit, top = set(), len(values), None
    for need in range(len(tails) - 1, -1, -1):
        limit = next(i for i in range(limit) if rank[i] == need and (top is None or values[i] < top))
        kept.add(limit)
        top = values[limit]
    return kept


def expand(candidate) -> list:
    """A candidate's pairs: a group gives all pairs of its members; anything malformed comes back as it is."""
    if isinstance(candidate, dict):
        members = candidate.get("members")
        if members is not None and len(members) >= 2:
            return [list(p) for p in itertools.combinations(members, 2)]
        if "node_i" in candidate and "node_j" in candidate:
            return [[candidate["node_i"], candidate["node_j"]]]
        return [candidate]
    return [[*candidate]]


def expand_groups(groups: DataFrame) -> DataFrame:
    """story_id, ord, a, b: all pairs of the members of groups (story_id, ord, members), in the order of expand."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in parts:
            rows = [(s, o, *pair) for s, o, members in zip(table["story_id"], table["ord"], table["members"]) for pair in expand({"members": members}) if len(pair) == 2]
            yield pd.DataFrame(rows, columns=["story_id", "ord", "a", "b"])

    kind = groups.schema["story_id"].dataType.simpleString()
    return groups.select("story_id", "ord", "members").mapInPandas(run, f"story_id {kind}, ord long, a string, b string")


def verify(nodes: list[tuple], orders: dict[str, list[str]], candidates: list, tie_break: str = "earliest") -> tuple[list, list]:
    """(kept pairs, log of (pair, kept, reason)): known ends in two threads, each pair once, and for every two threads the
    largest set of pairs whose order is the same in both."""
    thread = dict(nodes)
    place = {n: i for order in orders.values() for i, n in enumerate(order)}
    log, seen, groups = [], set(), {}
    for pair in itertools.chain.from_iterable(expand(c) for c in candidates):
        reason = None
        if not isinstance(pair, list) or len(pair) != 2:
            reason = "malformed"
        elif pair[0] == pair[1] or pair[0] not in thread or pair[1] not in thread:
            reason = "unknown_or_repeated_node"
        elif thread[pair[0]] == thread[pair[1]]:
            reason = "same_thread"
        elif frozenset(pair) in seen:
            reason = "duplicate"
        if reason:
            log.append((pair, False, reason))
            continue
        seen.add(frozenset(pair))
        groups.setdefault(frozenset(thread[n] for n in pair), []).append(pair)
    kept = []
    for pairs in groups.values():
        if len(pairs) == 1:
            kept.append(pairs[0])
            log.append((pairs[0], True, "sole_candidate"))
            continue
        lead = thread[pairs[0][0]]
        turned = sorted(([a, b] if thread[a] == lead else [b, a] for a, b in pairs), key=lambda p: place[p[0]])
        good = increasing([place[b] for _, b in turned], tie_break)
        for i, pair in enumerate(turned):
            log.append((pair, i in good, "consistent" if i in good else "breaks_order"))
            if i in good:
                kept.append(pair)
    return kept, log


def merge(orders: dict[str, list[str]], anchors: list) -> list[str]:
    """One order of all events: each thread is let out up to its next anchor, anchors stand side by side."""
    rest = {t: [*order] for t, order in orders.items()}
    home = {n: t for t, order in orders.items() for n in order}
    out: dict[str, None] = {}
    for pair in anchors:
        if len(pair) != 2 or any(n not in home for n in pair):
            continue
        for node in pair:
            queue = rest[home[node]]
            if node in out:
                continue
            upto = queue.index(node) + 1 if node in queue else len(queue)
            out.update(dict.fromkeys(queue[:upto]))
            out.setdefault(node)
            rest[home[node]] = queue[upto:]
    for t in sorted(rest):
        out.update(dict.fromkeys(rest[t]))
    return [*out]


def finish(stories: DataFrame, tie_break: str = "earliest") -> DataFrame:
    """stories (story_id, nodes array<struct<id, thread_id>>, edges array<struct<node_i, node_j, rel>> in order,
    candidates array<array<string>>) with thread_orders, convergence, log and global_order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in parts:
            rows = []
            for r in table.itertuples():
                nodes = [(n["id"], n["thread_id"]) for n in r.nodes]
                orders = thread_orders(nodes, [(e["node_i"], e["node_j"], e["rel"]) for e in r.edges])
                kept, log = verify(nodes, orders, [[*c] for c in r.candidates], tie_break)
                rows.append((r.story_id, {t: o for t, o in orders.items()}, kept, [{"pair": p, "kept": k, "reason": why} for p, k, why in log], merge(orders, kept)))
            yield pd.DataFrame(rows, columns=["story_id", "thread_orders", "convergence", "log", "global_order"])

    kind = stories.schema["story_id"].dataType.simpleString()
    schema = f"story_id {kind}, thread_orders map<string,array<string>>, convergence array<array<string>>, log array<struct<pair:array<string>,kept:boolean,reason:string>>, global_order array<string>"
    return stories.select("story_id", "nodes", "edges", "candidates").mapInPandas(run, schema)


def as_stories(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """One nested row a story from the relational tables; edges and candidates keep their ord."""
    n = nodes.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("id", "thread_id"))).alias("nodes"))
    e = edges.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_i", "node_j", "rel"))).alias("edges"))
    c = candidates.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "a", "b"))), lambda x: F.array(x["a"], x["b"])).alias("candidates"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    got = n.join(e, "story_id", "left").join(c, "story_id", "left")
    return got.select("story_id", "nodes", empty("edges", "array<struct<ord:bigint,node_i:string,node_j:string,rel:int>>").alias("edges"), empty("candidates", "array<array<string>>").alias("candidates"))


def merge_groups(flagged: DataFrame, missed: DataFrame) -> DataFrame:
    """Candidate groups of both passes (story_id, ord, members), each member set once; groups without members stay."""
    both = flagged.withColumn("_pass", F.lit(0)).unionByName(missed.withColumn("_pass", F.lit(1)))
    key = F.when(F.col("members").isNull(), F.concat_ws("-", "_pass", "ord")).otherwise(F.array_join(F.array_sort(F.array_distinct("members")), "|"))
    first = both.groupBy("story_id", key.alias("_key")).agg(F.min(F.struct("_pass", "ord", "members")).alias("f"))
    return first.select("story_id", F.col("f._pass").alias("pass"), F.col("f.ord").alias("ord"), F.col("f.members").alias("members"))


# ------------------------------------------------------------------ scores


def scored_edges(gold: DataFrame, predicted: DataFrame, order: DataFrame, distances: DataFrame) -> DataFrame:
    """Each gold edge with the prediction that counts for it: the pair itself, the reversed pair turned round, the
    order of its ends, or none; with predicted_from and score."""
    last = predicted.groupBy("story_id", "node_i", "node_j").agg(F.max_by("rel", "ord").alias("p"))
    direct = last.withColumnRenamed("p", "_d")
    turned = last.select("story_id", F.col("node_i").alias("node_j"), F.col("node_j").alias("node_i"), allen.inverse(F.col("p")).alias("_r"))
    at = lambda node, name: order.select("story_id", F.col("id").alias(node), F.col("position").alias(name))
    rows = gold.select("story_id", "node_i", "node_j", F.col("rel").alias("gold"), "ord")
    rows = rows.join(direct, ["story_id", "node_i", "node_j"], "left").join(turned, ["story_id", "node_i", "node_j"], "left").join(at("node_i", "_pi"), ["story_id", "node_i"], "left").join(at("node_j", "_pj"), ["story_id", "node_j"], "left")
    by_order = F.when(F.col("_pi") < F.col("_pj"), allen.ID["before"]).when(F.col("_pi").isNotNull() & F.col("_pj").isNotNull(), allen.ID["after"])
    source = F.when(F.col("_d").isNotNull(), "explicit").when(F.col("_r").isNotNull(), "explicit-reversed").when(by_order.isNotNull(), "derived-from-order").otherwise("missing")
    rows = rows.withColumns({"predicted": F.coalesce("_d", "_r", by_order), "predicted_from": source})
    dims = F.broadcast(distances.select(F.col("r1").alias("gold"), F.col("r2").alias("predicted"), "score"))
    return rows.join(dims, ["gold", "predicted"], "left").select("story_id", "node_i", "node_j", "ord", "gold", "predicted", "predicted_from", F.coalesce("score", F.lit(0.0)).alias("score"))


def relation_score(stories: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean edge score of each story; 1 without gold edges."""
    return stories.join(scored.groupBy("story_id").agg(F.avg("score").alias("_s")), "story_id", "left").select("story_id", F.coalesce("_s", F.lit(1.0)).alias("relation_score"))


def order_edges(gold: DataFrame, order: DataFrame) -> DataFrame:
    """Before or after for every gold pair whose ends are both ordered."""
    at = lambda node, name: order.select("story_id", F.col("id").alias(node), F.col("position").alias(name))
    rows = gold.join(at("node_i", "_pi"), ["story_id", "node_i"]).join(at("node_j", "_pj"), ["story_id", "node_j"])
    return rows.select("story_id", "node_i", "node_j", F.when(F.col("_pi") < F.col("_pj"), allen.ID["before"]).otherwise(allen.ID["after"]).alias("rel"), "ord")


def contingency(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """story_id, gold_label, predicted_label, n over events in both."""
    p = predicted.select("story_id", "id", F.col("thread_id").alias("predicted_label"))
    both = gold.select("story_id", "id", F.col("thread_id").alias("gold_label")).join(p, ["story_id", "id"]).where("gold_label IS NOT NULL AND predicted_label IS NOT NULL")
    return both.groupBy("story_id", "gold_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment with the largest total gain; the shorter side is used up.

    Shortest augmenting paths over reduced costs, a row at a time: rows * rows * columns steps. Of equal totals the one
    that these paths reach, which depends on the order of rows and columns alone.
    """
    if gain.shape[0] > gain.shape[1]:
        return sorted((r, c) for c, r in assignment(gain.T))
    cost = -gain.astype(float)
    rows, columns = cost.shape
    of_row, of_column = np.zeros(rows), np.zeros(columns)
    taken = np.full(columns, -1)
    for row in range(rows):
        least, via, closed = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, dtype=bool)
        at, column, reached = row, -1, 0.0
        while True:
            ahead = reached + cost[at] - of_row[at] - of_column
            nearer = ~closed & (ahead < least)
            least[nearer], via[nearer] = ahead[nearer], column
            column = int(np.where(closed, np.inf, least).argmin())
            reached = least[column]
            closed[column] = True
            if taken[column] < 0:
                break
            at = taken[column]
        of_row[row] += reached
        for c in np.flatnonzero(closed):
            if taken[c] >= 0:
                of_row[taken[c]] += reached - least[c]
            of_column[c] -= reached - least[c]
        while column >= 0:
            taken[column] = taken[via[column]] if via[column] >= 0 else row
            column = int(via[column])
    return sorted((int(r), c) for c, r in enumerate(taken) if r >= 0)


def best_mapping(counts: DataFrame) -> DataFrame:
    """story_id, predicted_label, gold_label of a one-to-one mapping with the most common events.

    Mappings with equally many give the same accuracy; which of them comes out depends on the labels' order alone.
    """

    def assign(table: pd.DataFrame) -> pd.DataFrame:
        gold, predicted = (sorted(set(table[c])) for c in ("gold_label", "predicted_label"))
        gain = table.pivot_table("n", "gold_label", "predicted_label", "sum", 0).reindex(index=gold, columns=predicted).to_numpy()
        pairs = assignment(gain)
        return pd.DataFrame({"story_id": table["story_id"].iloc[0], "predicted_label": [predicted[c] for _, c in pairs], "gold_label": [gold[r] for r, _ in pairs]})

    kind = counts.schema["story_id"].dataType.simpleString()
    return counts.groupBy("story_id").applyInPandas(assign, f"story_id {kind}, predicted_label string, gold_label string")


def thread_accuracy(gold: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Share of gold events whose predicted thread maps to theirs; an event that wasn't predicted is wrong."""
    p = predicted.select("story_id", "id", F.col("thread_id").alias("predicted_label")).join(mapping, ["story_id", "predicted_label"], "left")
    rows = gold.join(p.select("story_id", "id", "gold_label"), ["story_id", "id"], "left")
    return rows.groupBy("story_id").agg(F.avg(F.coalesce(F.col("gold_label") == F.col("thread_id"), F.lit(False)).cast("int")).alias("thread_accuracy"))


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select("story_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def set_scores(gold: DataFrame, predicted: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """precision, recall, f1, n_gold, n_predicted over unordered pairs, by story or, without stories, pooled.

    Both empty is 1, one of them empty 0.
    """
    g, p = unordered(gold).withColumn("g", F.lit(1)), unordered(predicted).withColumn("p", F.lit(1))
    both = g.join(p, ["story_id", "a", "b"], "full")
    sums = [F.count("g").alias("n_gold"), F.count("p").alias("n_predicted"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("_hits")]
    if stories is None:
        got = both.agg(*sums)
    else:
        got = stories.select("story_id").join(both.groupBy("story_id").agg(*sums), "story_id", "left").fillna(0, ["n_gold", "n_predicted", "_hits"])
    none = (F.col("n_gold") == 0) & (F.col("n_predicted") == 0)
    one = (F.col("n_gold") == 0) | (F.col("n_predicted") == 0)
    share = lambda n: F.when(none, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(F.col("_hits") / F.col(n))
    got = got.withColumns({"precision": share("n_predicted"), "recall": share("n_gold")})
    return got.withColumn("f1", F.when(none, F.lit(1.0)).otherwise(f1(F.col("precision"), F.col("recall")))).drop("_hits")


def closure_aware(salient: DataFrame, proposed: DataFrame, pool: DataFrame, stories: DataFrame) -> DataFrame:
    """precision_vs_pool against all valid pairs (the salient ones where a story has no pool), recall_salient, counts."""
    tag = lambda df, c: unordered(df).withColumn(c, F.lit(1))
    both = tag(salient, "s").join(tag(proposed, "q"), ["story_id", "a", "b"], "full").join(tag(pool, "v"), ["story_id", "a", "b"], "full")
    is_ = lambda c: F.col(c).isNotNull()
    sums = both.groupBy("story_id").agg(F.count("s").alias("n_salient"), F.count("q").alias("n_proposed"), F.count("v").alias("n_pool"), F.count_if(is_("q") & is_("s")).alias("_found"), F.count_if(is_("q") & (is_("s") | is_("v"))).alias("_valid"))
    got = stories.select("story_id").join(sums, "story_id", "left").fillna(0)
    precision = F.when(F.col("n_proposed") > 0, F.col("_valid") / F.col("n_proposed")).otherwise(F.when(F.col("n_salient") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    recall = F.when(F.col("n_salient") > 0, F.col("_found") / F.col("n_salient")).otherwise(F.lit(1.0))
    return got.select("story_id", precision.alias("precision_vs_pool"), recall.alias("recall_salient"), (F.col("n_pool") > 0).alias("pool_available"), "n_proposed", "n_salient", "n_pool")


def harmonic(scores: Column) -> Column:
    """Harmonic mean of an array; 0 if it is empty or any score is 0 or less."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, 1 / x).otherwise(F.lit(0.0)))
    return F.when((F.size(scores) == 0) | F.exists(scores, lambda x: x <= 0), F.lit(0.0)).otherwise(F.size(scores) / total)


def score_record(gold_nodes, predicted_nodes, gold_edges, predicted_edges, order, gold_pairs, predicted_pairs, pool) -> DataFrame:
    """All scores of each story in one row."""
    stories = gold_nodes.select("story_id").distinct()
    dims = allen.distance_dim(gold_nodes.sparkSession)
    rel = relation_score(stories, scored_edges(gold_edges, predicted_edges, order, dims))
    threads = thread_accuracy(gold_nodes, predicted_nodes, best_mapping(contingency(gold_nodes, predicted_nodes)))
    conv = set_scores(gold_pairs, predicted_pairs, stories).select("story_id", F.col("precision").alias("convergence_precision"), F.col("recall").alias("convergence_recall"), F.col("f1").alias("convergence_f1"))
    got = rel.join(threads, "story_id").join(conv, "story_id").join(closure_aware(gold_pairs, predicted_pairs, pool, stories), "story_id")
    core = harmonic(F.array("relation_score", "thread_accuracy"))
    return got.withColumns({"awt_core": core, "awt_f1": harmonic(F.array("relation_score", "thread_accuracy", "convergence_f1"))})


def gap(original: DataFrame, twin: DataFrame, metrics: list[str], key: str = "story_id") -> DataFrame:
    """original minus twin for each metric, as <metric>_gap."""
    other = twin.select(key, *[F.col(m).alias(f"_{m}") for m in metrics])
    return original.join(other, key).select(key, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_gap") for m in metrics])


def display(scored: DataFrame) -> DataFrame:
    """Edges with a hue from red (0) to green (120) for their score and a fixed jitter of -0.5 to 0.5 for their ends."""
    jitter = F.pmod(F.hash("story_id", "node_i", "node_j"), F.lit(1000)) / 1000 - 0.5
    return scored.withColumns({"hue": F.round(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) * 120).cast("int"), "jitter": jitter})


def node_scores(scored: DataFrame) -> DataFrame:
    """Mean score, number and display radius of the edges at each node."""
    ends = scored.select("story_id", F.explode(F.array("node_i", "node_j")).alias("id"), "score")
    return ends.groupBy("story_id", "id").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("degree")).withColumn("radius", F.least(F.lit(0.5), 0.18 + 0.045 * F.col("degree")))
