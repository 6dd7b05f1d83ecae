"""Best-fit packing of token sequences by linear grouping.

Only the histogram of piece lengths (one count for each length up to the capacity) reaches the driver. There the large
lengths are sorted, cut into GROUPS groups of equal cardinality and rounded up to the longest of their group; for these
few sizes, configurations of a sequence are found by filling it as far as a bounded subset sum allows, largest size
first, each as often as the counts last. Actual documents then take the configurations' places by their rank in
their group. The space that rounding left and that large pieces could not use goes to the small pieces in descending
length, each to the sequences with the least space that holds it; this too is planned on counts of equal spaces and
carried out by rank. The plan's size depends on the capacity and GROUPS, not on the number of documents.

Defined cases: a null or empty text is the final id alone, a piece of length 1. Only documents longer than the capacity
are cut: the first piece takes the remainder, all others are full and have a sequence each. Repeated rows and null
ids are packed as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

CAPACITY = 2048
GROUPS = 256
#: Pieces of at most this share of the capacity are small.
SMALL = 1 / 8
RANK_ROWS = 1024


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Merge ranks of a byte-level BPE file whose ids follow the merge order; None for any other file."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    try:
        return {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    except KeyError:
        return None


#: Encoders by path, for as long as a worker lives.
_ENCODERS: dict = {}


def encoder(path: str):
    """text -> ids like tokenizers' encode(text, add_special_tokens=False) with the file at path.

    The file's own library takes about four times as long as tiktoken with the same merges, which encodes all texts
    but those holding a special token's string.
    """
    import tiktoken
    from tokenizers import Tokenizer

    cache = _ENCODERS
    if path not in cache:
        own = Tokenizer.from_file(path)
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        if ranks is None:
            cache[path] = lambda text: own.encode(text, add_special_tokens=False).ids
        else:
            import public_tokenizers

            quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            cache[path] = lambda text: own.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else quick.encode_ordinary(text)
    return cache[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. The ids are the tokenizer's, then 0."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([each.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    arrow = pa.schema([(f.name, f.type) for f in common.arrow_schema(schema)])

    def run(batches):
        encode = encoder(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.array([*encode(text.as_py()), 0], dtype="<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at - 1) % capacity + 1
                    row.append(i), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at, k = at + n, k + 1
            cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return each.mapInArrow(run, schema)


def rank_within(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Add idx, the 0-based position among the rows of equal key; most: rows of the most frequent key.

    A key's rows are dealt into blocks of about RANK_ROWS and counted, so a hot key is no task's burden.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(max(1, -(-most // RANK_ROWS))))
    df = df.withColumn("_block", block)
    counts = df.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(key, "_block", (F.sum("_n").over(Window.partitionBy(key).orderBy("_block")) - F.col("_n")).alias("_before"))
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)) - 1)
    return local.join(before, [key, "_block"]).withColumn("idx", (F.col("_before") + F.col("_local")).cast("long")).drop("_block", "_n", "_before", "_local")


def _fill(sizes: list[int], counts: list[int], space: int, first: int) -> list[int]:
    """How many of each size (first index and later) fill the space best, by bounded subset sums."""
    reach, steps = 1, []
    mask = (1 << space + 1) - 1
    for i in range(first, len(sizes)):
        if not counts[i] or sizes[i] > space:
            continue
        steps.append((i, reach))
        for _ in range(min(counts[i], space // sizes[i])):
            more = (reach | reach << sizes[i]) & mask
            if more == reach:
                break
            reach = more
    total, take = reach.bit_length() - 1, [0] * len(sizes)
    for i, before in reversed(steps):
        while not before >> total & 1:
            total, take[i] = total - sizes[i], take[i] + 1
    return take


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, items of each size) that use up all counts; sizes descend."""
    left, out = [*counts], []
    for i in range(len(sizes)):
        while left[i]:
            left[i] -= 1
            take = _fill(sizes, left, capacity - sizes[i], i)
            left[i] += 1
            take[i] += 1
            times = min(n // t for n, t in zip(left, take) if t)
            left = [n - times * t for n, t in zip(left, take)]
            out.append((times, take))
    return out


def plan_large(hist: dict[int, int], capacity: int, groups: int) -> tuple[dict[int, int], int, list[tuple], int]:
    """Linear grouping: position of each length's first item, group cardinality, places and number of sequences.

    A place (group, low, high, base, per) puts the group's items low..high-1 into sequences from base, per at a time.
    """
    at, first, lengths = 0, {}, sorted(hist, reverse=True)
    for length in lengths:
        first[length], at = at, at + hist[length]
    if not at:
        return first, 1, [], 0
    q = max(1, -(-at // groups))
    sizes, counts, j = [], [], 0
    for low in range(0, at, q):
        while j + 1 < len(lengths) and first[lengths[j + 1]] <= low:
            j += 1
        sizes.append(lengths[j])
        counts.append(min(q, at - low))
    used, places, base = [0] * len(sizes), [], 0
    for times, take in configurations(sizes, counts, capacity):
        for g, per in enumerate(take):
            if per:
                places.append((g, used[g], used[g] + times * per, base, per))
                used[g] += times * per
        base += times
    return first, q, places, base


def plan_small(spaces: dict[int, int], hist: dict[int, int], capacity: int) -> tuple[dict[int, int], list[tuple], int]:
    """Best fit of small lengths: rank of the first sequence with each space, places and number of new sequences.

    A place (length, low, high, base, per, space) puts items low..high-1 into sequences from rank base, per each.
    """
    at, first = 0, {}
    for space in sorted(spaces):
        first[space], at = at, at + spaces[space]
    runs = {s: [(first[s], n)] for s, n in spaces.items()}
    known, fresh, places = sorted(runs), at, []

    def give(space, base, n):
        if n and space:
            if space not in runs:
                runs[space] = []
                insort(known, space)
            runs[space].append((base, n))

    for length in sorted(hist, reverse=True):
        low, left = 0, hist[length]
        while left:
            k = bisect_left(known, length)
            if k == len(known):
                space, base, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            else:
                space = known[k]
                base, n = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    known.pop(k)
            per = space // length
            got = min(left, per * n)
            places.append((length, low, low + got, base, per, space))
            whole, rest = divmod(got, per)
            give(space - per * length, base, whole)
            if rest:
                give(space - rest * length, base + whole, 1)
            give(space, base + whole + (rest > 0), n - whole - (rest > 0))
            low, left = low + got, left - got
    return first, places, fresh - at


def _place(spark: SparkSession, places: list[tuple], key: Column, at: Column) -> Column:
    """struct<low, base, per, space> of the place (key, low, high, base, per[, space]) that holds position at of a key.

    Places don't overlap, so the last that begins at the position or before it is the one; null if it ends before.
    """
    table = np.array([(*p, 0)[:6] for p in places] or np.zeros((0, 6)), dtype=np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("low long, base long, per long, space long")
    def run(keys: pd.Series, at: pd.Series) -> pd.DataFrame:
        table = shared.value
        found = pd.DataFrame({c: pd.array([None] * len(keys), dtype="Int64") for c in ("low", "base", "per", "space")})
        if not len(table):
            return found
        # keys and positions as one ordered number: the rank of the key, then the position
        names, first = np.unique(table[:, 0], return_index=True)
        span = max(int(table[:, 2].max()), int(at.max()) if len(at) else 0) + 1
        of = np.searchsorted(names, keys.to_numpy())
        known = names[np.minimum(of, len(names) - 1)] == keys.to_numpy()
        row = np.searchsorted(np.searchsorted(names, table[:, 0]) * span + table[:, 1], of * span + at.to_numpy(), "right") - 1
        row = np.maximum(row, 0)
        inside = known & (table[row, 0] == keys.to_numpy()) & (table[row, 1] <= at.to_numpy()) & (at.to_numpy() < table[row, 2])
        for name, column in (("low", 1), ("base", 3), ("per", 4), ("space", 5)):
            found[name] = pd.array(table[row, column], dtype="Int64")
            found.loc[~inside, name] = pd.NA
        return found

    return run(key, at)


def _small_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, columns))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, id_col="doc_id", text_col="text") -> DataFrame:
    """Pack all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = common.stage(pieces(docs, path or default_tokenizer(), capacity, id_col, text_col), "pieces")
    hist = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # one row for each length
    full = hist.get(capacity, 0)
    small_most = max(1, int(capacity * SMALL))
    first, q, places, n_large = plan_large({k: n for k, n in hist.items() if small_most < k < capacity}, capacity, groups)
    order = [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    placed = common.stage(rank_within(cut, "length", order, max(hist.values(), default=0)), "piece_ranks")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]

    by_length = _small_table(spark, [*first.items()], "length long, _first long")
    at = F.col("_first") + F.col("idx")
    large = placed.join(by_length, "length").withColumn("_group", F.floor(at / q).cast("long")).withColumn("_at", (at % q).cast("long"))
    large = large.withColumn("_p", _place(spark, places, F.col("_group"), F.col("_at")))
    large = large.withColumn("bin", (F.col("_p.base") + F.floor((F.col("_at") - F.col("_p.low")) / F.col("_p.per"))).cast("long"))
    in_bin = Window.partitionBy("bin").orderBy("_group", "_at")
    large = common.stage(large.select(*keep, "bin", (F.sum("length").over(in_bin) - F.col("length")).alias("offset")), "large_pieces")

    bins = common.stage(large.groupBy("bin").agg((F.lit(capacity) - F.sum("length")).cast("long").alias("space")), "sequences")
    spaces = {r.space: r["count"] for r in bins.groupBy("space").count().collect()}  # at most one row for each length
    first, places, n_new = plan_small({k: n for k, n in spaces.items() if k}, {k: n for k, n in hist.items() if k <= small_most and k < capacity}, capacity)
    by_space = _small_table(spark, [*first.items()], "space long, _first long")
    bins = rank_within(bins, "space", [F.col("bin")], max(spaces.values(), default=0)).join(by_space, "space")
    bins = bins.select("bin", (F.col("_first") + F.col("idx")).alias("_rank"))
    open_bins = sum(n for k, n in spaces.items() if k)
    small = placed.where((F.col("length") <= small_most) & (F.col("length") < capacity)).withColumn("_p", _place(spark, places, F.col("length"), F.col("idx")))
    nth = F.col("idx") - F.col("_p.low")
    small = small.select(*keep, (F.col("_p.base") + F.floor(nth / F.col("_p.per"))).cast("long").alias("_rank"), (F.lit(capacity) - F.col("_p.space") + nth % F.col("_p.per") * F.col("length")).alias("offset"))
    small = small.join(bins, "_rank", "left").withColumn("bin", F.coalesce("bin", F.col("_rank") - open_bins + n_large))

    shared = large.unionByName(small.drop("_rank"))
    shared = shared.select(*keep, (F.col("bin") + full).cast("long").alias("sequence_id"), F.col("offset").cast("long"))
    alone = placed.where(F.col("length") == capacity).select(*keep, F.col("idx").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents"))
