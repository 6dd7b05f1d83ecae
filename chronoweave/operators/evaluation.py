"""Benchmark evaluation: all examples as documents of one plan, then rates, confusion counts and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import allen
from chronoweave.sources.benchmark import as_statements

from . import graphs, statements


def evaluate(examples: DataFrame) -> DataFrame:
    """One row an example: id, category, expected, predicted, expected_consistent, predicted_consistent, is_correct,
    is_inferred. Examples that ought to be contradictory are right when a contradiction is found."""
    _, events, edges = statements.graph(as_statements(examples))
    broken = graphs.conflicts(edges, events).select(F.col("doc_id").alias("id")).distinct().withColumn("predicted_consistent", F.lit(False))
    ask = examples.select("id", F.posexplode("query").alias("side", "item"))
    ids = graphs.resolve(ask.select(F.col("id").alias("doc_id"), "item").distinct(), events)
    named = ask.join(ids.withColumnRenamed("doc_id", "id"), ["id", "item"])
    pair = named.groupBy("id").agg(F.max(F.when(F.col("side") == 0, F.col("event_id"))).alias("src"), F.max(F.when(F.col("side") == 1, F.col("event_id"))).alias("tgt"))
    got = graphs.answer(pair.withColumnRenamed("id", "doc_id"), edges).withColumnRenamed("doc_id", "id")
    rows = examples.join(got, "id", "left").join(broken, "id", "left")
    expected = allen.label(allen.parse_relation(F.col("expected")))
    rows = rows.select(
        "id", F.coalesce("category", F.lit("general")).alias("category"), expected.alias("expected"), allen.label(F.col("rel")).alias("predicted"),
        F.coalesce("is_consistent", F.lit(True)).alias("expected_consistent"), F.coalesce("predicted_consistent", F.lit(True)).alias("predicted_consistent"), F.coalesce("is_inferred", F.lit(True)).alias("is_inferred"),
    )
    right = F.when(~F.col("expected_consistent"), ~F.col("predicted_consistent")).otherwise(F.col("predicted").eqNullSafe(F.col("expected")))
    return rows.withColumn("is_correct", right)


def rate(hit: Column, of: Column, empty: float = 1.0) -> Column:
    """Share of hits among the rows of `of`."""
    n = F.count_if(of)
    return F.when(n == 0, F.lit(empty)).otherwise(F.count_if(of & hit) / n)


def overall(detail: DataFrame) -> DataFrame:
    """One row: totals, accuracy (also of explicit and inferred answers) and consistency rate."""
    asked = F.col("expected_consistent") & F.col("expected").isNotNull()
    right, inferred = F.col("is_correct"), F.col("is_inferred")
    same = F.col("expected_consistent") == F.col("predicted_consistent")
    return detail.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"), rate(right, F.lit(True), 0.0).alias("accuracy"), rate(right, asked & ~inferred).alias("explicit_accuracy"),
        rate(right, asked & inferred).alias("inferred_accuracy"), rate(same, F.lit(True), 0.0).alias("consistency_rate"),
    )


def by_category(detail: DataFrame) -> DataFrame:
    return detail.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.round(F.avg(F.col("is_correct").cast("int")), 4).alias("accuracy"))


def confusion(detail: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of every label that was expected or predicted."""
    asked = detail.where("expected_consistent AND expected IS NOT NULL")
    each = asked.select("expected", "predicted", F.explode(F.array_distinct(F.array_compact(F.array("expected", "predicted")))).alias("label"))
    is_ = lambda c: F.coalesce(F.col(c) == F.col("label"), F.lit(False))
    n = each.groupBy("label").agg(F.count_if(is_("expected") & is_("predicted")).alias("tp"), F.count_if(~is_("expected") & is_("predicted")).alias("fp"), F.count_if(is_("expected") & ~is_("predicted")).alias("fn"))
    share = lambda a, b: F.when(F.col("tp") + F.col(b) == 0, F.lit(1.0)).otherwise(F.col("tp") / (F.col("tp") + F.col(b)))
    n = n.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


def macro(counts: DataFrame) -> DataFrame:
    """One row: mean precision, recall and f1 over labels; 1 without labels."""
    return counts.agg(*[F.coalesce(F.avg(c), F.lit(1.0)).alias(f"{c}_macro") for c in ("precision", "recall", "f1")])


def report(detail: DataFrame) -> DataFrame:
    """Lines of the text report: line_no, line."""
    scores = overall(detail).crossJoin(macro(confusion(detail)))  # one row each
    percent = lambda title, c: F.format_string(f"{title:<25}%.1f%%", F.col(c) * 100)
    number = lambda title, c: F.format_string(f"{title:<25}%.3f", F.col(c))
    head = [
        F.lit("=" * 50), F.lit("          Temporal Reasoning Evaluation           "), F.lit("=" * 50), F.format_string(f"{'Total Examples:':<25}%d", F.col("total")),
        percent("Overall Accuracy:", "accuracy"), percent("Explicit Accuracy:", "explicit_accuracy"), percent("Inference Accuracy:", "inferred_accuracy"), percent("Consistency Rate:", "consistency_rate"),
        number("Macro Precision:", "precision_macro"), number("Macro Recall:", "recall_macro"), number("Macro F1 Score:", "f1_macro"), F.lit("-" * 50), F.lit("Category Breakdown:"),
    ]
    top = scores.select(F.posexplode(F.array(*head)).alias("line_no", "line")).select("line_no", F.lit("").alias("category"), "line")
    line = F.format_string("  - %-26s: %d/%d (%.1f%%)", "category", "correct", "total", F.col("accuracy") * 100)
    body = by_category(detail).select(F.lit(100).alias("line_no"), "category", line.alias("line"))
    end = scores.select(F.lit(200).alias("line_no"), F.lit("").alias("category"), F.lit("=" * 50).alias("line"))
    return top.unionByName(body).unionByName(end).orderBy("line_no", "category").select("line_no", "category", "line")


def save(detail: DataFrame, path: str) -> None:
    """Write the metrics as JSON to path/results (one line with nested categories) and the report's lines to path/report."""
    categories = by_category(detail).agg(F.array_sort(F.collect_list(F.struct("category", "total", "correct", "accuracy"))).alias("categories"))
    overall(detail).crossJoin(macro(confusion(detail))).crossJoin(categories).coalesce(1).write.mode("overwrite").json(f"{path}/results")
    report(detail).coalesce(1).sortWithinPartitions("line_no", "category").select("line").write.mode("overwrite").text(f"{path}/report")
