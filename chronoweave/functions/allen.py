"""Allen's interval algebra as columns and small dimension tables.

A relation is a number 0..12 in canonical order; a set of relations is a 13-bit mask, so union, intersection and size
are bit_or, bit_and and bit_count. All tables are derived from the endpoints of enumerated intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 13 relations in canonical order, as spelled in narrative graphs.
RELATIONS = ("equals", "before", "after", "meets", "met-by", "overlaps", "overlapped-by", "starts", "started-by", "during", "contains", "finishes", "finished-by")
#: The same in the spelling of symbolic statements.
SYMBOLIC = ("equal", "before", "after", "meets", "met_by", "overlaps", "overlapped_by", "starts", "started_by", "during", "contains", "finishes", "finished_by")
ID = {name: i for i, name in enumerate(SYMBOLIC)} | {name: i for i, name in enumerate(RELATIONS)}
ALL_MASK = (1 << len(RELATIONS)) - 1
#: Relations in which the first interval is known to begin no later and end earlier, or the reverse.
PRECEDES = ("before", "meets", "overlaps", "finished-by")
FOLLOWS = ("after", "met-by", "overlapped-by", "finishes")
#: Names that statements may use for a relation.
ALIASES = {
    "before": "before", "earlier": "before", "precedes": "before", "prior": "before",
    "after": "after", "later": "after", "succeeds": "after", "following": "after",
    "equal": "equal", "equals": "equal", "same_time": "equal", "simultaneous": "equal",
    "meets": "meets", "met_by": "met_by", "overlaps": "overlaps", "overlapped_by": "overlapped_by",
    "during": "during", "within": "during", "contains": "contains", "includes": "contains",
    "starts": "starts", "started_by": "started_by", "finishes": "finishes", "finished_by": "finished_by",
}
#: The deterministic compositions that the partial table knows, besides those with equal.
CORE = (
    ("before", "before", "before"), ("before", "meets", "before"), ("before", "overlaps", "before"), ("before", "during", "before"), ("before", "starts", "before"),
    ("meets", "before", "before"), ("meets", "meets", "before"),
    ("after", "after", "after"), ("after", "met_by", "after"), ("after", "overlapped_by", "after"),
    ("during", "during", "during"), ("during", "before", "before"), ("during", "after", "after"),
    ("contains", "contains", "contains"),
)
#: Pairs of relations that exclude each other on the same ordered pair of events.
DISJOINT = (("before", "after"), ("before", "equal"), ("before", "during"), ("after", "equal"), ("after", "during"), ("meets", "before"), ("meets", "after"))


def label(rel: Column, names=SYMBOLIC) -> Column:
    """Name of a relation number; null for null."""
    return F.when(rel.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), rel + 1))


def rel_id(name: Column, names=RELATIONS) -> Column:
    """Number of a relation name; null for unknown ones."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, at.cast("int") - 1)


def relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Relation number of two intervals; total, instants included (an instant at a border meets it)."""
    n = lambda name: F.lit(ID[name])
    by_start = F.when(s1 == s2, F.when(e1 == e2, n("equal")).when(e1 < e2, n("starts")).otherwise(n("started_by")))
    by_end = by_start.when(e1 == e2, F.when(s1 > s2, n("finishes")).otherwise(n("finished_by")))
    inside = by_end.when((s1 > s2) & (e1 < e2), n("during")).when((s1 < s2) & (e1 > e2), n("contains"))
    partly = inside.when(s1 < s2, n("overlaps")).otherwise(n("overlapped_by"))
    apart = F.when(e1 < s2, n("before")).when(s1 > e2, n("after")).when(e1 == s2, n("meets")).when(s1 == e2, n("met_by"))
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, apart.otherwise(partly))


def proper_relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Relation number of two intervals of positive length; null if one is degenerate."""
    return F.when((s1 < e1) & (s2 < e2), relation(s1, e1, s2, e2))


def partial_relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct<rel, flipped>: what partly bounded events tell; flipped if the edge goes from the second to the first."""
    before = lambda flipped: F.struct(F.lit(ID["before"]).alias("rel"), F.lit(flipped).alias("flipped"))
    full = F.struct(relation(s1, e1, s2, e2).alias("rel"), F.lit(False).alias("flipped"))
    both = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    points = s1.isNotNull() & s2.isNotNull() & e1.isNull() & e2.isNull()
    equal = F.struct(F.lit(ID["equal"]).alias("rel"), F.lit(False).alias("flipped"))
    return F.when(both, full).when(e1 < s2, before(False)).when(e2 < s1, before(True)).when(points, F.when(s1 < s2, before(False)).when(s2 < s1, before(True)).otherwise(equal))


def inverse(rel: Column) -> Column:
    """Number of the inverse: equals is its own, the others come in pairs."""
    return F.when(rel == 0, rel).otherwise((rel - 1).bitwiseXOR(F.lit(1)) + 1)


def bit(rel: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), rel)


def sign(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _intervals(spark: SparkSession, n: int, s: str, e: str) -> DataFrame:
    points = spark.range(n)
    return points.select(F.col("id").alias(s)).crossJoin(points.select(F.col("id").alias(e))).where(F.col(s) < F.col(e))


def relation_dim(spark: SparkSession) -> DataFrame:
    """13 rows: rel, name, symbolic, inverse, signs (of the four comparisons of endpoints), strict, precedes, follows."""
    pairs = _intervals(spark, 8, "s1", "e1").withColumns({"s2": F.lit(2), "e2": F.lit(5)})
    cols = [F.col(c) for c in ("s1", "e1", "s2", "e2")]
    s1, e1, s2, e2 = cols
    signs = F.array(sign(s1, s2), sign(s1, e2), sign(e1, s2), sign(e1, e2))
    rows = pairs.groupBy(relation(*cols).alias("rel")).agg(F.first(signs).alias("signs"))
    among = lambda names: F.col("rel").isin([ID[n] for n in names])
    return rows.select("rel", label(F.col("rel"), RELATIONS).alias("name"), label(F.col("rel")).alias("symbolic"), inverse(F.col("rel")).alias("inverse"), "signs", among(("before", "meets")).alias("strict"), among(PRECEDES).alias("precedes"), among(FOLLOWS).alias("follows"))


def distance_dim(spark: SparkSession) -> DataFrame:
    """169 rows: r1, r2, distance (comparisons of endpoints that differ), score = 1 - distance / 6."""
    dim = relation_dim(spark).select("rel", "signs")
    a, b = dim.toDF("r1", "a"), dim.toDF("r2", "b")
    differ = F.aggregate(F.zip_with("a", "b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)
    return a.crossJoin(b).select("r1", "r2", differ.alias("distance"), F.greatest(F.lit(0.0), 1 - differ / F.lit(6)).alias("score"))


def composition_dim(spark: SparkSession) -> DataFrame:
    """169 rows: r1, r2, mask of the relations that A r1 B and B r2 C allow between A and C."""
    a = _intervals(spark, 16, "s1", "e1").withColumn("r1", relation(F.col("s1"), F.col("e1"), F.lit(5), F.lit(10)))
    c = _intervals(spark, 16, "s3", "e3").withColumn("r2", relation(F.lit(5), F.lit(10), F.col("s3"), F.col("e3")))
    r3 = relation(F.col("s1"), F.col("e1"), F.col("s3"), F.col("e3"))
    return a.crossJoin(c).groupBy("r1", "r2").agg(F.bit_or(bit(r3)).cast("int").alias("mask"))


def core_dim(spark: SparkSession) -> DataFrame:
    """39 rows: r1, r2, r3 of the partial table, equal on either side included."""
    rows = {(ID[a], ID[b], ID[c]) for a, b, c in CORE} | {x for r in range(13) for x in ((0, r, r), (r, 0, r))}
    return spark.createDataFrame(sorted(rows), "r1 int, r2 int, r3 int")


def full_dim(spark: SparkSession) -> DataFrame:
    """r1, r2, r3 for every pair whose true composition is a single relation."""
    only = composition_dim(spark).where(F.bit_count("mask") == 1)
    return only.select("r1", "r2", (F.log2("mask")).cast("int").alias("r3"))


def parse_relation(text: Column) -> Column:
    """Relation number of a name or alias; null for unknown ones. Case, hyphens and blanks around it don't matter."""
    bare = F.lower(F.trim(text))
    norm = F.translate(bare, "- ", "__")
    aliases = F.create_map(*[F.lit(x) for name, target in ALIASES.items() for x in (name, ID[target])])
    return F.coalesce(aliases[norm], rel_id(bare, SYMBOLIC))


def register(spark: SparkSession) -> None:
    """SQL functions allen_relation, allen_inverse and allen_label for the session."""
    n = ID
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION allen_relation(s1 TIMESTAMP_NTZ, e1 TIMESTAMP_NTZ, s2 TIMESTAMP_NTZ, e2 TIMESTAMP_NTZ) RETURNS INT RETURN "
        f"CASE WHEN e1 < s2 THEN {n['before']} WHEN s1 > e2 THEN {n['after']} WHEN e1 = s2 THEN {n['meets']} WHEN s1 = e2 THEN {n['met_by']} "
        f"WHEN s1 = s2 THEN CASE WHEN e1 = e2 THEN {n['equal']} WHEN e1 < e2 THEN {n['starts']} ELSE {n['started_by']} END "
        f"WHEN e1 = e2 THEN CASE WHEN s1 > s2 THEN {n['finishes']} ELSE {n['finished_by']} END "
        f"WHEN s1 > s2 AND e1 < e2 THEN {n['during']} WHEN s1 < s2 AND e1 > e2 THEN {n['contains']} WHEN s1 < s2 THEN {n['overlaps']} WHEN s1 > s2 THEN {n['overlapped_by']} END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION allen_inverse(r INT) RETURNS INT RETURN CASE WHEN r = 0 THEN 0 ELSE ((r - 1) ^ 1) + 1 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION allen_label(r INT) RETURNS STRING RETURN element_at(array(" + ", ".join(f"'{x}'" for x in SYMBOLIC) + "), r + 1)")
