"""Toxicity scores: Levenshtein automata over a learned lexicon, with context windows for quotation.

The lexicon holds word stems and whole words that mark documents labelled toxic: document frequencies of all stems in
toxic documents, then of those candidates in clean ones, and a likelihood-ratio test corrected for their number. Terms
stand in a trie; the product of that trie with the Levenshtein automaton of one edit is made deterministic state by
state as words ask for it, so that a word is dropped as soon as no term is within reach. A hit weighs the log odds of
its term (exact or misspelled), less when its window of WINDOW words quotes or reports it; a logistic function of
the strongest hit, the sum of the strongest five and their number gives the score.

Learning reads at most TRAIN_DOCS documents of each label, chosen by the hash of their id; scoring reads whole texts.

Defined cases: a null text is the empty text, which has no hits and the score of documents without one. Null labels
teach nothing; of several labels of a document the highest counts. Without both labels every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS = 20_000
STEMS = (3, 8)
#: Likelihood-ratio statistic that a term needs beyond twice the log of the number of candidates.
MARGIN = 8.0
#: Least ratio of a term's frequencies in toxic and clean documents.
RATIO = 8.0
#: Shortest term that may be misspelled.
FUZZY_LEN = 5
THRESHOLD = 0.3
#: Weight of a misspelling that the training documents don't hold, as a share of its term's.
UNSEEN = 0.75
WINDOW = 6
QUOTED = 0.25
CACHE = 400_000
#: Marks that open or close a quotation, and words that report one.
QUOTE_MARKS = "\"“”„«»‘"
REPORTING = {"said", "says", "called", "quote", "quoted", "wrote", "word", "term"}

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def stems_of(word: str) -> list[str]:
    """The stems of a word, and the whole word with a closing mark."""
    word = _EDGE.sub("", word)
    return [*(word[:n] for n in range(STEMS[0], min(STEMS[1], len(word)) + 1)), f"{word}$"] if len(word) >= STEMS[0] else []


class Matcher:
    """The lexicon's trie and the lazily determinised automaton for one edit at most."""

    def __init__(self, terms: list[str]):
        self.kids, self.whole, self.stem, self.length = [{}], [[]], [[]], []
        for i, term in enumerate(terms):
            letters, node = term.removesuffix("$"), 0
            self.length.append(len(letters))
            for c in letters:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({}), self.whole.append([]), self.stem.append([])
                node = self.kids[node][c]
            (self.whole if term.endswith("$") else self.stem)[node].append(i)
        self.ids: dict = {}
        self.states: list = []
        self.next: list[dict] = []
        self.start = self._state({(0, 0)})

    def _state(self, places: set) -> int:
        """The state of (node, edits) places; -1 is the dead one."""
        todo = list(places)
        while todo:  # a left-out letter moves down without reading
            node, edits = todo.pop()
            for kid in self.kids[node].values() if edits == 0 else ():
                if (kid, 1) not in places:
                    places.add((kid, 1))
                    todo.append((kid, 1))
        places = frozenset(p for p in places if not (p[1] and (p[0], 0) in places))
        if not places:
            return -1
        if places not in self.ids:
            self.ids[places] = len(self.states)
            fine = lambda i, e: e == 0 or self.length[i] >= FUZZY_LEN
            self.states.append((places, *([(i, e) for node, e in places for i in ends[node] if fine(i, e)] for ends in (self.stem, self.whole))))
            self.next.append({})
        return self.ids[places]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.states[state][0]:
            if c in self.kids[node]:
                out.add((self.kids[node][c], edits))
            if edits == 0:
                out.add((node, 1))
                out.update((kid, 1) for kid in self.kids[node].values())
        self.next[state][c] = to = self._state(out)
        return to

    def hits(self, word: str) -> dict[int, int]:
        """Terms within reach of a word and their edits."""
        found: dict[int, int] = {}
        state, word = self.start, _EDGE.sub("", word)
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return found
            for i, e in self.states[state][1]:
                found[i] = min(e, found.get(i, e))
        for i, e in self.states[state][2]:
            found[i] = min(e, found.get(i, e))
        return found


def _quoted(words: list[str], at: int) -> bool:
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    opens = any(w[0] in QUOTE_MARKS for w in [*before, words[at]])
    closes = any(w.rstrip(".,;:!?)")[-1:] in QUOTE_MARKS for w in [words[at], *after] if w)
    return opens and closes or any(_EDGE.sub("", w) in REPORTING for w in before[-3:])


def found(matcher: Matcher, text: str | None, cache: dict) -> list[tuple[int, int, bool]]:
    """Distinct (term, edits, quoted) of a text; of a term's hits the one with the fewest edits, unquoted if any is."""
    words = words_of(text)
    hot = {}
    for w in set(words):
        got = cache.get(w)
        if got is None:
            if len(cache) >= CACHE:
                cache.clear()
            got = cache[w] = tuple(matcher.hits(w).items())
        if got:
            hot[w] = got
    best: dict[int, tuple[int, bool]] = {}
    if hot:
        for at, w in enumerate(words):
            if w in hot:
                quoted = _quoted(words, at)
                for term, edits in hot[w]:
                    best[term] = min(best.get(term, (edits, quoted)), (edits, quoted))
    return [(t, e, q) for t, (e, q) in best.items()]


def features(hits, exact: list[float], fuzzy: list[float]) -> tuple[float, float, float]:
    weights = sorted(((exact[t] if e == 0 else fuzzy[t]) * (QUOTED if q else 1.0) for t, e, q in hits), reverse=True)
    weights = [w for w in weights if w > 0]
    return (weights[0], sum(weights[:5]), math.log1p(len(weights))) if weights else (0.0, 0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _llr(a: float, b: float, t: float, c: float) -> float:
    """Twice the log likelihood ratio of frequencies a of t and b of c against one common frequency."""
    part = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)
    p = (a + b) / (t + c)
    return 2 * (part(a, t, a / t) + part(b, c, b / c) - part(a, t, p) - part(b, c, p)) if 0 < p < 1 else 0.0


def _frequencies(docs: DataFrame, only: set[str] | None) -> DataFrame:
    """Documents that hold each stem: stem, n."""

    def run(batches):
        counts = Counter()
        for b in batches:
            for text in b.column(0):
                got = set()
                for w in set(words_of(text.as_py())):
                    got.update(stems_of(w))
                counts.update(got if only is None else got & only)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["stem", "n"])

    return docs.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", per_label: int = TRAIN_DOCS):
    """(terms, weights when exact, weights when misspelled, coefficients) from the labelled rows of docs.

    Labels of documents that docs doesn't hold have no part in it. All terms that pass the test are kept; their number is
    bounded by the sample, which has about per_label documents of each label.
    """
    labels = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("_toxic"))
    labels = labels.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")  # labels of other documents tell nothing
    known = {r["_toxic"]: r["count"] for r in labels.groupBy("_toxic").count().collect()}
    if len(known) < 2:
        return [], [], [], np.zeros(0)
    share = F.when(F.col("_toxic") == 1, per_label / known[1]).otherwise(per_label / known[0])
    some = labels.where(F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    # about 2 * per_label rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id")
    rows = common.stage(rows.select("text", "_toxic"), "labelled")
    n = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    t, c = n.get(1, 0), n.get(0, 0)
    if not t or not c:
        return [], [], [], np.zeros(0)
    least = max(3, math.ceil(0.002 * t))
    toxic = {r.stem: r.n for r in _frequencies(rows.where("_toxic = 1"), None).where(F.col("n") >= least).collect()}
    clean = {r.stem: r.n for r in _frequencies(rows.where("_toxic = 0"), set(toxic)).collect()}
    need = 2 * math.log(max(2, len(toxic))) + MARGIN
    odds = lambda a, b: math.log((a + 0.5) / (t + 1)) - math.log((b + 0.5) / (c + 1))
    good = []
    for stem, a in toxic.items():
        b = clean.get(stem, 0)
        if (a + 0.5) / (t + 1) >= RATIO * (b + 0.5) / (c + 1) and _llr(a, b, t, c) >= need:
            good.append((_llr(a, b, t, c), len(stem), stem))
    terms: list[str] = []
    chosen: set[str] = set()
    taken: set[str] = set()  # terms and all that they start with
    for _, _, stem in sorted(good, reverse=True):
        bare = stem.removesuffix("$")
        if bare not in taken and not any(bare[:k] in chosen for k in range(STEMS[0], len(bare) + 1)):
            terms.append(stem)
            chosen.add(stem)
            taken.update(bare[:k] for k in range(STEMS[0], len(bare) + 1))
    exact = [odds(toxic[s], clean.get(s, 0)) for s in terms]

    def hits(batches):
        matcher, cache = Matcher(terms), {}
        for b in batches:
            got = [found(matcher, text.as_py(), cache) for text in b.column(0)]
            kind = pa.list_(pa.struct([("t", pa.int32()), ("e", pa.int32()), ("q", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([[{"t": i, "e": e, "q": q} for i, e, q in x] for x in got], kind)], names=["toxic", "hits"])

    rows = rows.select("text", "_toxic").mapInArrow(hits, "toxic int, hits array<struct<t:int,e:int,q:boolean>>").toArrow()
    y = rows["toxic"].to_numpy().astype(float)
    each = [[(h["t"], h["e"], h["q"]) for h in x] for x in rows["hits"].to_pylist()]
    # what a misspelling says is learned where no exact term has said it already
    plain = [[x for x, of in zip(each, y) if of == label and all(e for _, e, _ in x)] for label in (1, 0)]
    near = [Counter(i for x in some for i, _, _ in x) for some in plain]
    t0, c0 = map(len, plain)
    fuzzy_odds = lambda i: math.log((near[0][i] + 0.5) / (t0 + 1)) - math.log((near[1][i] + 0.5) / (c0 + 1))
    fuzzy = [fuzzy_odds(i) if near[0][i] + near[1][i] else exact[i] * UNSEEN for i in range(len(terms))]
    x = np.array([features(h, exact, fuzzy) for h in each])
    weight = np.where(y == 1, known[1] / t, known[0] / c)
    return terms, exact, fuzzy, _logistic(x, y, weight / weight.mean())


def score(docs: DataFrame, model, text_col="text", name: str = "toxic_score") -> DataFrame:
    """docs with the score behind its own columns, under the given name or, if docs has it, with underscores before it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, exact, fuzzy, beta = shared.value
        matcher, cache = Matcher(terms), {}
        for texts in batches:
            if not len(beta):
                yield pd.Series(np.zeros(len(texts)))
                continue
            x = np.array([features(found(matcher, text, cache), exact, fuzzy) for text in texts]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30))))

    run = F.pandas_udf(scores, "double")
    return docs.withColumn(common.free_name(docs.columns, name), run(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    labels = common.read_table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out), labels.where(common.fold(F.col("doc_id"), 4) != 2))
    got = score(docs, model)
    return got.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
