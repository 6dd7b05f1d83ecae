"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the fractional number of copies target / size of its source. Its fractional part is
rounded by pairing documents of one source: a random transfer of words (copies times size) between the two makes one
of them integral and keeps their sum and both expectations, so a source's total stays at its target. Leaves of at most
LEAF documents are rounded side by side; each leaves at most one undecided document, and those meet again in
groups of FAN_IN leaves, level by level, until one per source is left, which a last draw rounds.

Defined cases: a null or word-less text has size 0 and adds nothing to any total; its copies are drawn independently.
A null source is a source of its own, after all others. Rows that repeat id, source and size share one decision, so a
rerun gives the same copies whatever the partitioning. Null ids are such repeats too. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAF = 1024
FAN_IN = 64
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: sid (rank by code point, null last), source_size, n_docs, target.

    sizes: source, size. Targets are shares of `share` times all sizes by weight; what a source cannot take beyond
    `cap` times its size goes to the others by weight, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = common.ranked(per, [F.col("source").asc_nulls_last()], "sid")
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = common.stage(per.withColumn("weight", F.element_at(table, (F.col("sid") % len(weights) + 1).cast("int"))), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(cap))
    rate, full = 0.0, None
    while True:  # rate: words for each unit of weight of the sources that are not full
        is_full = F.lit(False) if full is None else limit <= F.col("weight") * F.lit(full)
        got = per.agg(F.sum(F.when(is_full, limit)).alias("given"), F.sum(F.when(~is_full, F.col("weight"))).alias("left")).first()
        if not got.left:
            rate = float("inf")
            break
        rate = (share * total - (got.given or 0.0)) / got.left
        if full is not None and rate <= full:
            break
        full = rate
    target = limit if rate == float("inf") else F.least(limit, F.col("weight") * F.lit(rate))
    return per.withColumn("target", target.cast("double")).drop("weight")


def _pivot(seed: int, level: int, last: bool):
    """Round one group: sequential pivots in descending size; `frac` is 0 or 1 afterwards but for one open row."""

    def run(key, table):
        table = table.sort_by([("unit_size", "descending"), ("tie", "ascending"), ("doc_id", "ascending"), ("copies_of", "ascending")])
        p = table["frac"].to_numpy().astype(float)
        s = table["unit_size"].to_numpy().astype(float)
        draw = np.random.default_rng([seed, level, int(key[0].as_py()), int(key[1].as_py())]).random(len(p) + 1)
        i = -1
        for j in range(len(p)):
            if s[j] == 0:
                p[j] = float(draw[j] < p[j])
            if p[j] < EPS or p[j] > 1 - EPS:
                p[j] = round(p[j])
                continue
            if i < 0:
                i = j
                continue
            up, down = min((1 - p[i]) * s[i], p[j] * s[j]), min(p[i] * s[i], (1 - p[j]) * s[j])
            move = up if draw[j] * (up + down) < down else -down
            p[i], p[j] = p[i] + move / s[i], p[j] - move / s[j]
            open_i, open_j = EPS < p[i] < 1 - EPS, EPS < p[j] < 1 - EPS
            if not open_i:
                p[i] = round(p[i])
            if not open_j:
                p[j] = round(p[j])
            i = i if open_i else j if open_j else -1
        if last and i >= 0:
            p[i] = float(draw[-1] < p[i])
        return table.set_column(table.schema.get_field_index("frac"), "frac", pa.array(p))

    return run


def copies(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 11, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Decisions of the mix: doc_id, source, size, copies_of (rows that share the decision), source_size, target, copies."""
    sizes = common.stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), common.word_count(F.col(text_col)).alias("size")), "sizes")
    per = common.stage(targets(sizes, weights, share, cap), "targets")
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies_of"))
    units = units.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    exact = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(min(share, cap)))
    whole = F.floor(exact + F.lit(EPS))
    tie = F.xxhash64(F.lit(seed), "doc_id", "size")
    units = units.select(
        "doc_id", "source", "size", "copies_of", "sid", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(exact - whole, F.lit(0.0)).alias("frac"),
        (F.col("size") * F.col("copies_of")).alias("unit_size"), tie.alias("tie"),
        F.pmod(tie, F.ceil(F.col("n_docs") / F.lit(LEAF)).cast("long")).alias("block"),
    )
    groups = per.agg(F.max(F.ceil(F.col("n_docs") / F.lit(LEAF)))).first()[0] or 1
    decided, level, schema = None, 0, units.schema
    while True:
        last = groups <= 1
        done = units.groupBy("sid", "block").applyInArrow(_pivot(seed, level, last), schema)
        if last:
            decided = done if decided is None else decided.unionByName(done)
            break
        done = common.stage(done, "pivots")
        is_open = (F.col("frac") > 0) & (F.col("frac") < 1)
        decided = done.where(~is_open) if decided is None else decided.unionByName(done.where(~is_open))
        units = done.where(is_open).withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
        groups, level = -(-int(groups) // FAN_IN), level + 1
    return decided.select("doc_id", "source", "size", "copies_of", "source_size", "target", (F.col("whole") + F.round("frac").cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixed corpus: every row of docs as often as its copies say, with the columns of docs."""
    chosen = copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where(F.col("copies") > 0)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), common.word_count(F.col(text_col)).alias("_size"))
    joined = rows.join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size")))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_n")
    return joined.select("row", again).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = copies(common.read_table(spark, sf_dir, "documents"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_of"))).alias("_n")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return got.select("doc_id", F.col("size"), F.col("source_size"), F.col("target"), taken, F.col("copies"), each).drop("_n")


