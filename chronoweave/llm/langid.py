"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character bigrams and trigrams of the lower-cased text are hashed into BUCKETS buckets for each length. Counts are summed by
language over at most TRAIN_DOCS labelled documents a language, chosen by the hash of their id, so every part of the
corpus is represented and a rerun picks the same. The matrix of log probabilities (2 * BUCKETS rows, one column a
language, MAX_LANGS columns at most) is broadcast; batches are scored by gathering its rows in numpy.

Besides the posterior probability, which is near 1 for any text of some length, a text gets the fit of its language: how
much likelier its n-grams are there, in nats for each, than if all buckets were as likely. It is below 0 for texts that
are in none of the learned languages, whatever their length.

Defined cases: a null text and one without a letter are `und` with score and fit 0, as is every text when nothing was
learned. Ties go to the language that sorts first. Only the MAX_LANGS languages with the most training documents are learned.
Extra columns are kept; the score of a text depends on nothing but the text and the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZES = (2, 3)
BUCKETS = 1 << 16
TRAIN_DOCS = 20_000
MAX_LANGS = 512
ALPHA = 0.5
UNKNOWN = "und"
#: Characters that are scored at a time.
SLAB = 1 << 20

_FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


def buckets(chars: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each place, one row for each n-gram length; two places at the end are padding."""
    n = len(chars) - max(SIZES) + 1
    out = np.empty((len(SIZES), n), dtype=np.int64)
    mixed = [chars[i : i + n] * _FACTORS[i] for i in range(max(SIZES))]
    for row, size in enumerate(SIZES):
        h = mixed[0].copy()
        for m in mixed[1:size]:
            h += m
            h ^= h >> np.uint32(15)
        out[row] = ((h * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64) % BUCKETS + row * BUCKETS
    return out


def _slabs(texts):
    """(indices of texts, starts, bucket rows) of about SLAB characters; a longer text comes in several slabs."""
    pad = max(SIZES) - 1
    index, starts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        chars = np.frombuffer((text.lower() + "\0" * pad).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for low in range(0, len(chars) - pad, SLAB):
            index.append(i)
            starts.append(size)
            parts.append(buckets(chars[low : low + SLAB + pad]))
            size += parts[-1].shape[1]
            if size >= SLAB:
                yield index, starts, np.concatenate(parts, axis=1)
                index, starts, parts, size = [], [], [], 0
    if index:
        yield index, starts, np.concatenate(parts, axis=1)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray  # (buckets, languages)


def predict(langs: list[str], prior: np.ndarray, logp: np.ndarray, texts) -> tuple[list[str], list[float], list[float]]:
    """Language of each text, its posterior probability and its fit."""
    texts = [t if isinstance(t, str) else None for t in texts]
    total, grams = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    for index, starts, rows in _slabs(texts) if langs else ():
        np.add.at(grams, index, len(SIZES) * np.diff([*starts, rows.shape[1]]))
        for row in rows:
            np.add.at(total, index, np.add.reduceat(logp[row], starts, axis=0))
    lang, score, fit = [], [], []
    for text, row, n in zip(texts, total, grams):
        if text is None or not langs or not any(map(str.isalpha, text)):
            lang.append(UNKNOWN), score.append(0.0), fit.append(0.0)
            continue
        joint = row + prior
        best = int(joint.argmax())
        lang.append(langs[best]), score.append(float(1 / np.exp(joint - joint[best]).sum())), fit.append(float(row[best] / n + np.log(BUCKETS)))
    return lang, score, fit


def train(docs: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", per_lang: int = TRAIN_DOCS) -> Model:
    """Learn from the rows of docs whose text and label aren't null."""
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    n = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r.lang for r in n)
    count = {r.lang: r["count"] for r in n}
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 0), np.float32))
    number, share = F.lit(None).cast("int"), F.lit(0.0)
    for i, lang in enumerate(langs):
        number = F.when(F.col("lang") == lang, i).otherwise(number)
        share = F.when(F.col("lang") == lang, per_lang / count[lang]).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def counted(batches):
        sums = np.zeros((len(langs), len(SIZES) * BUCKETS), dtype=np.int64)
        for b in batches:
            lang = b.column(1).to_numpy()
            for index, starts, rows in _slabs(b.column(0).to_pylist()):
                of = np.repeat(lang[index], np.diff([*starts, rows.shape[1]]))
                for row in rows:
                    sums += np.bincount(of * sums.shape[1] + row, minlength=sums.size).reshape(sums.shape)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["cell", "n"])

    rows = docs.where(drawn < share).select("text", number.alias("lang")).where(F.col("lang").isNotNull())
    cells = rows.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(len(langs) * len(SIZES) * BUCKETS)
    sums[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    sums = sums.reshape(len(langs), len(SIZES), BUCKETS) + ALPHA
    logp = np.log(sums / sums.sum(axis=2, keepdims=True)).reshape(len(langs), -1)
    prior = np.array([count[lang] for lang in langs], dtype=float)
    return Model(langs, np.log(prior / prior.sum()), np.ascontiguousarray(logp.T, dtype=np.float32))


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang, score, fit> of a text column."""
    shared = spark.sparkContext.broadcast((model.langs, model.prior, model.logp))

    @F.pandas_udf("lang string, score double, fit double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lang", "score", "fit"), predict(*shared.value, texts))))

    return run(text)


def identify(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_fit behind its own columns; a name that docs has gets underscores before it."""
    got = common.free_name(docs.columns, "_lang")
    names = [F.col(f"{got}.{field}").alias(common.free_name(docs.columns, name)) for field, name in (("lang", "lang_pred"), ("score", "lang_score"), ("fit", "lang_fit"))]
    return docs.withColumn(got, predicted(docs.sparkSession, model, F.col(text_col))).select(*docs.columns, *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    got = identify(docs.select("doc_id", "text"), train(docs.where(~held_out)))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
