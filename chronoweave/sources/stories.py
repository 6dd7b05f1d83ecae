"""Story, prediction and authoring documents: schemas, scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import allen

THREAD = "struct<id:string,label:string,granularity:string>"
EVENT = "struct<id:string,thread_id:string,time_expr:string,text:string>"
EDGE = "struct<node_i:string,node_j:string,allen_relation:string,evidence_span:string>"
STORY = f"story_id string, title string, source string, threads array<{THREAD}>, events array<{EVENT}>, edges array<{EDGE}>, convergence_points array<array<string>>, convergence_pool array<array<string>>, id_map_from_original map<string,string>"
PREDICTION = (
    f"events array<struct<id:string,thread_id:string>>, edges array<{EDGE}>, raw_edges array<{EDGE}>, thread_orders map<string,array<string>>, global_order array<string>, convergence_points array<array<string>>, model string, "
    "candidate_convergence_pairs variant, awt_f1_scores struct<relation_score:double,thread_attribution_accuracy:double,awt_core:double,convergence_f1:double,convergence_precision_vs_pool:double,convergence_recall_salient:double>"
)
MANIFEST = "stories array<struct<id:string,dir:string,title:string>>"
#: JSON schemas of a model's replies.
REPLIES = {"node": "nodes array<struct<id:string,thread_id:string>>", "edge": f"edges array<{EDGE}>, convergence_points array<struct<members:array<string>,shared_detail:string>>", "direct": "events array<struct<id:string,thread_id:string>>, global_order array<string>, convergence_points array<array<string>>"}


#: Specs from which stories are built: intervals in minutes, edges as pairs, ordered renames.
SPEC = f"story_id string, title string, source string, threads array<{THREAD}>, events array<struct<id:string,thread_id:string,time_expr:string,text:string,start:int,end:int>>, edges array<array<string>>, convergence_points array<array<string>>, counterfactual_names array<struct<old:string,new:string>>"


def read_specs(spark: SparkSession, pattern: str) -> DataFrame:
    """Interval specs as JSON; nothing in a spec is executed."""
    return spark.read.schema(SPEC).option("multiLine", True).json(pattern)


def _named(df: DataFrame, pattern: str, *names: str) -> DataFrame:
    path = F.input_file_name()
    return df.withColumns({n: F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")) for i, n in enumerate(names)})


def read_stories(spark: SparkSession, pattern: str, only: list[str] | None = None) -> DataFrame:
    """Story files <dir>/<variant>.json with dir and variant; only keeps some directories."""
    got = _named(spark.read.schema(STORY).option("multiLine", True).json(pattern), r"([^/]+)/([^/]+)\.json$", "dir", "variant")
    return got.where(F.col("dir").isin(only)) if only else got


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("stories").alias("s")).select("s.*")


def read_predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """Prediction files story_XX_<condition>.json with dir and condition; missing files are no error."""
    reader = spark.read.schema(PREDICTION).option("multiLine", True).option("ignoreMissingFiles", True)
    return _named(reader.json(pattern), r"(story_\d+)_?([^/]*)\.json$", "dir", "condition")


def with_predictions(stories: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stories with their prediction, stories without one)."""
    both = stories.join(predictions.withColumnRenamed("dir", "_dir"), F.col("dir") == F.col("_dir"), "left")
    return both.where("_dir IS NOT NULL"), both.where("_dir IS NULL").select("dir")


def tables(stories: DataFrame, key: str = "dir") -> dict[str, DataFrame]:
    """The relational tables of nested stories: threads, events, edges, pairs, pool."""
    k = F.col(key).alias("story_id")
    each = lambda c: stories.select(k, F.posexplode(c).alias("ord", "x"))
    pair = lambda c: each(c).select("story_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("ord").cast("long").alias("ord"))
    out = {"events": each("events").select("story_id", "ord", "x.*"), "pairs": pair("convergence_points")}
    out["edges"] = each("edges").select("story_id", F.col("ord").cast("long").alias("ord"), "x.node_i", "x.node_j", F.col("x.allen_relation").alias("label"), allen.rel_id(F.col("x.allen_relation")).alias("rel"))
    if "threads" in stories.columns:
        out["threads"] = each("threads").select("story_id", "ord", "x.*")
    if "convergence_pool" in stories.columns:
        out["pool"] = pair("convergence_pool")
    if "global_order" in stories.columns:
        out["order"] = each("global_order").select("story_id", F.col("x").alias("id"), F.col("ord").alias("position"))
    return out


def candidate_pairs(value: Column) -> Column:
    """array<array<string>> of a VARIANT of candidates in any of their three shapes; malformed ones are left out."""
    flat = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.try_variant_get(v, "$.members", "array<string>"), F.array(F.try_variant_get(v, "$.node_i", "string"), F.try_variant_get(v, "$.node_j", "string")))
    members = F.transform(F.try_variant_get(value, "$", "array<variant>"), flat)
    pairs = F.transform(members, lambda m: F.flatten(F.transform(m, lambda a, i: F.transform(F.slice(m, i + 2, F.size(m)), lambda b: F.array(a, b)))))
    return F.filter(F.flatten(pairs), lambda p: p[0].isNotNull() & p[1].isNotNull())


def write_variants(stories: DataFrame, path: str) -> None:
    """One folder for each story and variant."""
    stories.write.mode("overwrite").partitionBy("story_id", "variant").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Put rows, which may come from path itself, in the place of the folder path.

    They are written beside it in full first; then the old folder is moved aside, the new one moved in, and the old one
    deleted. A crash leaves the old or the new folder whole, under path or under the name with .old or .new behind it.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = lambda end="": jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end)
    df.write.mode("overwrite").json(path.rstrip("/") + ".new")
    files = at().getFileSystem(conf)
    if files.exists(at()):
        files.delete(at(".old"), True)
        _moved(files, at(), at(".old"))
    _moved(files, at(".new"), at())
    files.delete(at(".old"), True)


def _moved(files, source, target) -> None:
    if not files.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def best_view(stories: DataFrame, predictions: DataFrame, wanted: str, fall_back: list[str]) -> DataFrame:
    """For each story its prediction of the wanted condition, or of the first there is in fall_back."""
    rank = F.array_position(F.array(*[F.lit(c) for c in [wanted, *fall_back]]), F.coalesce("condition", F.lit("")))
    known = predictions.withColumn("_rank", rank).where("_rank > 0")
    nth = F.row_number().over(Window.partitionBy("dir").orderBy("_rank"))
    return stories.select("dir").join(known.withColumn("_n", nth).where("_n = 1").drop("_n", "_rank"), "dir", "left")
