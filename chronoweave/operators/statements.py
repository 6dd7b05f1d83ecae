"""Statements to events and relations: sentence splitting, classification, naming of events, bounds.

Input is doc_id, epoch (the number of the statement within its document) and text. Sentences are classified by
patterns in a fixed order; each pattern that a sentence reaches registers its subject, so events are numbered by their
first mention. Pronouns stand for the event that the sentence before them ended on.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import allen, spans

from . import graphs

#: The patterns of bounds, in the order in which they are tried.
BOUNDS = {
    "duration": r"(?i)^(it|the\s+meeting|the\s+event|[A-Za-z0-9_'\s]+?)\s+(?:lasted|lasted\s+for|took|ran\s+for)\s+(.+)$",
    "start": r"(?i)^(.*?)\s+(?:started|began|commenced|arrived|happened|occurred)\s+(?:at|on|in)?\s*(.+)$",
    "end": r"(?i)^(.*?)\s+(?:ended|finished|adjourned|concluded|left)\s+(?:at|on)\s+(.+)$",
}
#: The patterns of relations, in the order in which they are tried.
RELATIONS = (
    ("before", r"(?i)^(.*?)\s+(?:happened|occurred|arrived|left|took\s+place)?\s*(?:is\s+)?before\s+(.*?)$"),
    ("after", r"(?i)^(.*?)\s+(?:happened|occurred|arrived|left|took\s+place)?\s*(?:is\s+)?after\s+(.*?)$"),
    ("during", r"(?i)^(.*?)\s+(?:happened|occurred)?\s*(?:is\s+)?during\s+(.*?)$"),
    ("meets", r"(?i)^(.*?)\s+(?:meets|met)\s+(.*?)$"),
    ("contains", r"(?i)^(.*?)\s+(?:contains|contained|includes)\s+(.*?)$"),
    ("starts", r"(?i)^(.*?)\s+(?:starts|started)\s+(.*?)$"),
    ("finishes", r"(?i)^(.*?)\s+(?:finishes|finished)\s+(.*?)$"),
    ("equal", r"(?i)^(.*?)\s+(?:happened\s+at\s+the\s+same\s+time\s+as|is\s+equal\s+to|equals|equal|at\s+the\s+same\s+time\s+as)\s+(.*?)$"),
)
#: Words that stand for the last event, verbs that are no part of a name.
PRONOUNS = ("it", "the event", "this event")
VERBS = r"(?i)\b(arrived|left|started|ended|happened|occurred|departed)\b"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """array<string> of the sentences of a text, cut at dots, semicolons and line ends."""
    return F.filter(F.transform(F.split(text, r"[;\n.]+"), trimmed), lambda s: s != "")


def clean_entity(text: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(F.regexp_replace(text, VERBS, "")), F.lit("")), text)


def parse(statements: DataFrame, anchor: datetime | None = None) -> DataFrame:
    """One row a sentence: doc_id, epoch, pos, raw, statement_type, source, target, rel, bound_type, bound_ts, bound_us,
    mentions. source and target are descriptions; pos numbers the sentences of a document."""
    rows = statements.select("doc_id", "epoch", F.posexplode(sentences(F.col("text"))).alias("_i", "raw"))
    in_doc = Window.partitionBy("doc_id").orderBy("epoch", "_i")
    rows = rows.withColumn("pos", F.row_number().over(in_doc)).drop("_i")
    s = F.col("raw")
    for name, pattern in BOUNDS.items():
        hit = F.regexp_like(s, F.lit(pattern))
        rows = rows.withColumn(f"_{name}", F.when(hit, trimmed(F.regexp_extract(s, pattern, 1)))).withColumn(f"_{name}_rest", F.when(hit, trimmed(F.regexp_extract(s, pattern, 2))))
    rows = rows.withColumn("_us", F.nullif(spans.first_resolved(F.col("_duration_rest"), "us", anchor), F.lit(0)))
    rows = rows.withColumn("_s", F.when(F.col("_us").isNull(), spans.first_resolved(F.col("_start_rest"), "ts", anchor)))
    rows = rows.withColumn("_e", F.when(F.col("_us").isNull() & F.col("_s").isNull(), spans.first_resolved(F.col("_end_rest"), "ts", anchor)))
    bound = F.when(F.col("_us").isNotNull(), "duration").when(F.col("_s").isNotNull(), "start").when(F.col("_e").isNotNull(), "end")
    rows = rows.withColumn("bound_type", bound)
    found = F.lit(None).cast("struct<rel:int,a:string,b:string>")
    for name, pattern in reversed(RELATIONS):
        a, b = trimmed(F.regexp_extract(s, pattern, 1)), trimmed(F.regexp_extract(s, pattern, 2))
        whole = F.regexp_like(s, F.lit(pattern)) & (a != "") & (b != "")
        found = F.when(whole, F.struct(F.lit(allen.ID[name]).alias("rel"), clean_entity(a).alias("a"), clean_entity(b).alias("b"))).otherwise(found)
    rows = rows.withColumn("_r", F.when(F.col("bound_type").isNull(), found))
    kind = F.when(F.col("bound_type").isNotNull(), "EVENT_BOUND").when(F.col("_r").isNotNull(), "RELATION").otherwise("UNPARSED")
    rows = rows.withColumn("statement_type", kind)

    first = F.col("pos") == 1
    names = lambda c: F.when(F.col(c).isNotNull() & (first | ~F.lower(c).isin(*PRONOUNS)), F.col(c))
    tried = {"duration": F.lit(True), "start": F.col("_us").isNull(), "end": F.col("_us").isNull() & F.col("_s").isNull()}
    mentions = [F.when(reached, names(f"_{name}")) for name, reached in tried.items()]
    mentions += [F.col("_r.a"), F.col("_r.b"), F.when(F.col("statement_type") == "UNPARSED", s)]
    subject = F.coalesce(*[F.when(F.col("bound_type") == name, F.col(f"_{name}")) for name in BOUNDS])
    rows = rows.withColumn("_subject", subject)
    own = F.when(F.col("statement_type") == "RELATION", F.col("_r.b")).when(F.col("statement_type") == "UNPARSED", s).otherwise(names("_subject"))
    carried = F.last(described(own), ignorenulls=True).over(in_doc_by_pos())
    rows = rows.withColumn("_last", carried)
    source = F.when(F.col("statement_type") == "RELATION", described(F.col("_r.a"))).when(F.col("statement_type") == "UNPARSED", described(s)).otherwise(F.col("_last"))
    rows = rows.select(
        "doc_id", "epoch", "pos", "raw", "statement_type", source.alias("source"), F.when(F.col("statement_type") == "RELATION", described(F.col("_r.b"))).alias("target"), F.col("_r.rel").alias("rel"), "bound_type",
        F.coalesce("_s", "_e").alias("bound_ts"), F.col("_us").alias("bound_us"), F.array_compact(F.array(*[described(m) for m in mentions])).alias("mentions"), F.col("_last").alias("last_event"),
    )
    return graphs.stage(rows, "parsed")  # else what reads it evaluates the patterns again


def in_doc_by_pos():
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def described(name: Column) -> Column:
    """The description that an event gets from a mention."""
    return F.when(name.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(trimmed(name), r"\.+$", ""), F.lit("")), F.lit("Event")))


def event_ids(parsed: DataFrame) -> DataFrame:
    """doc_id, key, event_id, ord, description: events numbered by first mention, whatever the case."""
    each = parsed.select("doc_id", "pos", F.posexplode("mentions").alias("_i", "description"))
    firsts = each.groupBy("doc_id", F.lower("description").alias("key")).agg(F.min(F.struct("pos", "_i", "description")).alias("f"))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.pos", "f._i"))
    return firsts.select("doc_id", "key", F.concat(F.lit("E"), ord_.cast("string")).alias("event_id"), ord_.cast("long").alias("ord"), F.col("f.description").alias("description"))


def versions(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """The states of every event: its bounds as last stated, from the epoch since to before the epoch until (null: for good).

    A state lasts until a statement names the event again, so there is a row for each epoch that names it.
    """
    said = parsed.where("statement_type <> 'UNPARSED'").select("doc_id", "epoch", "pos", "bound_type", "bound_ts", "bound_us", F.explode(F.array_compact(F.array("source", "target"))).alias("_name"))
    last = lambda kind, value: F.max_by(F.when(F.col("bound_type") == kind, F.col(value)), F.when(F.col("bound_type") == kind, F.col("pos")))
    at = said.groupBy("doc_id", F.lower("_name").alias("key"), F.col("epoch").alias("since")).agg(last("start", "bound_ts").alias("_s"), last("end", "bound_ts").alias("_e"), last("duration", "bound_us").alias("_d"))
    w = Window.partitionBy("doc_id", "key").orderBy("since")
    carried = {new: F.last(old, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for new, old in (("start_time", "_s"), ("end_time", "_e"), ("duration_us", "_d"))}
    got = at.withColumns(carried | {"until": F.lead("since").over(w)})
    return got.join(ids, ["doc_id", "key"]).select("doc_id", "event_id", "ord", "description", "start_time", "end_time", "duration_us", "since", "until")


def events(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of the graph with their last stated bounds."""
    return versions(parsed, ids).where("until IS NULL").drop("since", "until")


def edges(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """The explicit edges of relation statements."""
    ends = lambda side, new: ids.select("doc_id", F.col("key").alias(f"_{side}"), F.col("event_id").alias(new))
    said = parsed.where("statement_type = 'RELATION'").withColumns({"_source": F.lower("source"), "_target": F.lower("target")})
    said = said.join(ends("source", "src"), ["doc_id", "_source"]).join(ends("target", "tgt"), ["doc_id", "_target"])
    return said.select("doc_id", *graphs.edge(F.col("rel"), F.col("src"), F.col("tgt"), F.format_string("Explicit statement: '%s'", "raw"), F.col("pos").cast("long"), inferred=False))


def graph(statements: DataFrame, anchor: datetime | None = None, dim: DataFrame | None = None, by_epoch: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed, events, closed edges) of all documents at once.

    by_epoch: what times imply is read off after every statement, and nothing is taken back later, as when statements
    are added one at a time: states of two events are compared if they held in the same epoch. Since inference only adds,
    one closure over all those edges gives the same graph.
    """
    spark = statements.sparkSession
    parsed = parse(statements, anchor)
    ids = graphs.stage(event_ids(parsed), "ids")
    final = events(parsed, ids)
    start = edges(parsed, ids)
    if by_epoch:
        start = start.unionByName(graphs.bound_edges(graphs.complete_bounds(graphs.stage(versions(parsed, ids), "versions"))).select(*graphs.EDGE))
        return parsed, graphs.complete_bounds(final), graphs.closure(start, dim or allen.core_dim(spark))
    return parsed, graphs.complete_bounds(final), graphs.closure(start, dim or allen.core_dim(spark), final)
