"""Similarity join on word shingles: a MinHash LSH forest with exact verification.

Identical texts are one node. A node's signature holds TREES * DEPTH minima of its shingles' hashes; each tree takes DEPTH of
them as its label, and the sorted labels of a tree are a prefix trie. Two texts of similarity t meet at depth k of some
trie with probability 1 - (1 - t^k)^TREES.

All tries are climbed together, from depth DEPTH up to the longest k at which that chance reaches the target recall at the
threshold. At each depth only those trie nodes are opened that still hold leaves of different components. The leaves of an
opened node, sorted by label, are joined by a spanning forest: pairs with the longest common prefix first, then shorter
ones, and among them the best estimate; m leaves propose m - 1 pairs at most. Proposals are verified on the full shingle
sets and components are taken before the prefix is shortened again. The first depth asks FIRST_TREES tries, the others
all, with at most DELEGATES leaves of each component. A node over BLOCK leaves is dealt into blocks at random, anew at
each depth and in each tree.

What the climb leaves apart is compared in full: every pair of nodes of different components that shares any bucket (trie
node of the last depth) is verified exactly, without estimates. A bucket over BLOCK members is dealt into blocks and each
pair of blocks is one group of rows, so no bucket is gathered in one task; large components get blocks of their own, which
are not compared with each other. Once classes are final, links are counted by comparing all nodes of a class alike, block
against block, and only counts leave the comparison. The work on a group of m different texts grows with m * m, the rows
with m * m / BLOCK.

Defined cases: words are runs without ASCII white space, shingles SHINGLE consecutive words; a shorter text is one
shingle of all its words. A text without words is linked to nothing; identical texts (null and empty are equal) are one
class all the same. Repeated rows are copies. Null ids come after all others when a class is named. An empty table
gives no rows; extra columns are kept by dedup().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES = 14
#: Trees that the first depth asks; the others only see what those left apart.
FIRST_TREES = 4
DEPTH = 5
#: The climb proposes no pair whose estimate is this many standard deviations of TREES * DEPTH draws below the threshold.
SLACK = 4.5
BLOCK = 256
DELEGATES = 64
SLAB = 1 << 20
#: Shingles that a comparison of blocks multiplies at once.
WIDTH = 4096

_rng = np.random.default_rng(51)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MUL = _rng.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_POSITION = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix whose chance to match in some tree reaches the recall at the threshold; 1 at least."""
    return max((k for k in range(1, DEPTH + 1) if 1 - (1 - threshold**k) ** TREES >= recall), default=1)


def _powers(n: int, state={"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}) -> tuple[np.ndarray, np.ndarray]:
    if len(state["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            state[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, dtype=np.uint64))])
    return state["up"][:n], state["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(31)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    text = np.frombuffer(data, np.uint8)
    space = _SPACE[text]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, stop = edges[::2], edges[1::2]
    up, down = _powers(len(text) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[text] * up[:-1], dtype=np.uint64)])
    return _mixed((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64)), first


def _shingles(words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of documents whose words begin at start (each has one at least), and where a document's begin."""
    n = np.diff(np.append(start, len(words)))
    count = np.maximum(n - SHINGLE + 1, 1)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    doc = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(doc)) - begin[doc] + start[doc]
    out = np.zeros(len(doc), dtype=np.uint64)
    last = start[doc] + n[doc]
    for k in range(SHINGLE):
        place = at + k
        inside = place < last
        out += np.where(inside, words[np.minimum(place, len(words) - 1)] + np.uint64(1), np.uint64(0)) * _POSITION[k]
    return _mixed(out), begin


def _documents(texts):
    """(indices of texts, shingle hashes, begins) for slabs of the texts that have words."""
    index, parts, size = [], [], 0

    def slab():
        data = b" ".join(parts)
        words, first = _word_hashes(data)
        bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        start = np.searchsorted(first, bounds)
        some = np.diff(np.append(start, len(words))) > 0
        if some.any():
            return np.array(index)[some], *_shingles(words, start[some])

    for i, text in enumerate(texts):
        if not text:
            continue
        index.append(i), parts.append(text)
        size += len(text)
        if size >= SLAB:
            if got := slab():
                yield got
            index, parts, size = [], [], 0
    if parts and (got := slab()):
        yield got


def _sketch(k: int):
    """Batches (.., text) to (.., prefixes, sig), both null without words.

    prefixes: a 64-bit hash of each tree's first k minima; sig: the lowest byte of each minimum, to estimate from.
    """

    def run(batches):
        for b in batches:
            sig, prefixes = (np.full(b.num_rows, None, dtype=object) for _ in range(2))
            for index, hashes, begin in _documents(b.column(b.num_columns - 1).to_pylist()):
                x = (hashes >> np.uint64(32)).astype(np.uint32)
                minima = np.empty((len(begin), TREES * DEPTH), dtype=np.uint32)
                for i in range(TREES * DEPTH):
                    minima[:, i] = np.minimum.reduceat(x * _MUL[i] + _ADD[i], begin)
                sig[index] = [row.tobytes() for row in minima.astype(np.uint8)]
                prefixes[index] = [row.tobytes() for row in _prefixes(minima, k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prefixes, pa.binary()), pa.array(sig, pa.binary())], names=[*b.schema.names[:-1], "prefixes", "sig"])

    return run


def _prefixes(minima: np.ndarray, k: int) -> np.ndarray:
    """(rows, TREES) 64-bit hashes of each tree's first k minima."""
    out = np.zeros((len(minima), TREES), dtype=np.uint64)
    for t in range(TREES):
        for i in range(k):
            out[:, t] = _mixed(out[:, t] * np.uint64(_BASE) + minima[:, t * DEPTH + i].astype(np.uint64) + np.uint64(t + 1))
    return out


def _sets(batches):
    """Batches (key, text) to (key, shingles): the sorted distinct hashes."""
    for b in batches:
        keys, out, at = b.column(0), [], []
        for index, hashes, begin in _documents(b.column(1).to_pylist()):
            for i, some in zip(index, np.split(hashes, begin[1:])):
                at.append(i), out.append(np.unique(some).tobytes())
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], names=["key", "shingles"])


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(good)], names=["a", "b", "near"])

    return run


def _forest(weight: np.ndarray):
    """Edges (x, y) of a heaviest spanning forest; weights below 0 are no edges, inf joins without being an edge to give."""
    m = len(weight)
    best, by, left = np.full(m, -2.0), np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    for _ in range(m):
        x = int(np.where(left, best, -3).argmax())
        if 0 <= best[x] < np.inf:
            yield int(by[x]), x
        left[x] = False
        closer = weight[x] > best
        best[closer], by[closer] = weight[x][closer], x


def _propose(k_min: int, least: float):
    """Batches (bucket, block, tree, tail, node, comp, sig) sorted by bucket, block and tail to candidate pairs across components.

    The rows of a block are the leaves of a trie node, its sorted labels; m of them give m - 1 pairs at most.
    """
    total = TREES * DEPTH

    def weights(tree, comp, sig):
        same = np.zeros((len(sig), len(sig)), dtype=np.int32)
        prefix, alive = np.zeros_like(same), np.ones(same.shape, dtype=bool)
        for i in range(total):
            equal = sig[:, i][:, None] == sig[:, i]
            same += equal
            if tree * DEPTH + k_min <= i < (tree + 1) * DEPTH:
                alive &= equal
                prefix += alive
        weight = np.where(same >= least * total, prefix * (total + 1.0) + same, -1.0)
        weight[comp[:, None] == comp] = np.inf
        return weight

    def group(table):
        node, comp, raw = (table[c].to_pylist() for c in ("node", "comp", "sig"))
        if len(node) < 2 or all(c == comp[0] for c in comp):
            return
        sig = np.frombuffer(b"".join(raw), np.uint8).reshape(len(node), total)
        if len(node) == 2:
            edges = [(0, 1)] if (sig[0] == sig[1]).sum() >= least * total else []
        else:
            edges = _forest(weights(table["tree"][0].as_py(), np.unique(np.array(comp, dtype=object), return_inverse=True)[1], sig))
        for x, y in edges:
            yield min(node[x], node[y]), max(node[x], node[y])

    return _by_group(["bucket", "block"], group, [("a", pa.binary()), ("b", pa.binary())])


def _by_group(keys: list, group, fields: list):
    """Batches sorted by keys to the rows that group makes of the rows of each key."""

    def run(batches):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            if held is not None:
                table = pa.concat_tables([held, table])
            cut = cuts(table)
            yield from made(table, cut)
            held = table.slice(cut[-1])
        if held is not None:
            yield from made(held, [*cuts(held), held.num_rows])

    def cuts(table):
        columns = [table[k].to_numpy() for k in keys]
        new = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def made(table, cut):
        rows = [r for low, high in zip(cut[:-1], cut[1:]) for r in group(table.slice(low, high - low))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return run


def _common(left: list, right: list) -> np.ndarray:
    """The number of common values of each of left with each of right, sorted distinct values each."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if len(left) * len(right) <= 4:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    if left is right:
        values, times = np.unique(np.concatenate(left), return_counts=True)
        shared = values[times > 1]
    else:
        shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(shared):
        return out

    def places(sets):
        value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
        inside = shared[at] == value
        at, row = at[inside], row[inside]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    def slab(side, low, n):
        at, row = side[0], side[1]
        first, stop = np.searchsorted(at, (low, low + WIDTH))
        m = np.zeros((n, min(WIDTH, len(shared) - low)), dtype=np.float32)
        m[row[first:stop], at[first:stop] - low] = 1
        return m

    x = places(left)
    y = x if left is right else places(right)
    for low in range(0, len(shared), WIDTH):
        a = slab(x, low, len(left))
        b = a if left is right else slab(y, low, len(right))
        out += (a @ b.T).astype(np.int64)
    return out


def _near(table, threshold: float):
    """(rows of one block, rows of the other, whether they reach the threshold); one block compared with itself has each pair once."""
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    side = table["side"].to_numpy()
    low, high = (np.flatnonzero(side == k) for k in (0, 1))
    alone = table["x"][0].as_py() == table["y"][0].as_py()
    if len(low) + alone < 2 if alone else not (len(low) and len(high)):
        return None
    left = [sets[i] for i in low]
    if alone:
        high, right = low, left
    else:
        right = [sets[i] for i in high]
    both = _common(left, right)
    n, m = (np.array([len(s) for s in part]) for part in (left, right))
    near = both >= threshold * (n[:, None] + m - both) - 1e-9
    return low, high, np.triu(near, 1) if alone else near


def _link(threshold: float):
    """Of a pair of blocks, the links that join its components: one for each that two of them become one."""

    def group(table):
        node, comp = table["node"].to_pylist(), table["comp"].to_pylist()
        if all(c == comp[0] for c in comp) or (got := _near(table, threshold)) is None:
            return
        low, high, near = got
        number = np.unique(np.array(comp, dtype=object), return_inverse=True)[1]
        near = near & (number[low][:, None] != number[high])
        parent = list(range(len(comp)))

        def root(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, j in zip(*np.nonzero(near)):
            x, y = low[i], high[j]
            p, q = root(number[x]), root(number[y])
            if p != q:
                parent[p] = q
                yield min(node[x], node[y]), max(node[x], node[y])

    return _by_group(["bucket", "x", "y"], group, [("a", pa.binary()), ("b", pa.binary())])


def _count(threshold: float):
    """Of a pair of blocks, the number of links of each node."""

    def group(table):
        node = table["node"].to_pylist()
        if (got := _near(table, threshold)) is None:
            return
        low, high, near = got
        n = np.bincount(low, near.sum(axis=1), len(node)) + np.bincount(high, near.sum(axis=0), len(node))
        for i in np.flatnonzero(n):
            yield node[i], int(n[i])

    return _by_group(["bucket", "x", "y"], group, [("node", pa.binary()), ("n", pa.int64())])


def _key(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _members(nodes: DataFrame, k_min: int) -> DataFrame:
    """(bucket, tree, tail, node) of all buckets with two nodes or more; tail: the rest of the node's label in that tree."""
    leaf = lambda t: F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("prefixes", 8 * t + 1, 8)).alias("bucket"), F.substring("sig", t * DEPTH + k_min + 1, DEPTH - k_min).alias("tail"))
    each = nodes.where(F.col("sig").isNotNull()).select("key", F.explode(F.array(*map(leaf, range(TREES)))).alias("p"))
    each = each.select("p.bucket", "p.tree", "p.tail", F.col("key").alias("node"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("_bucket"))
    return common.stage(each.join(shared, each["bucket"] == shared["_bucket"]).drop("_bucket"), "buckets")


def _at_depth(members: DataFrame, k: int, k_min: int) -> DataFrame:
    """members with the trie nodes of depth k for buckets."""
    return members.withColumn("bucket", F.xxhash64("bucket", F.substring("tail", 1, k - k_min))) if k > k_min else members


def _delegates(members: DataFrame, comps: DataFrame, round_: int) -> DataFrame:
    """(bucket, tree, tail, node, comp) of the buckets that still hold several components, DELEGATES of each at most.

    Which ones changes with the round; the smallest hash in each of DELEGATES shares is found without a sort.
    """
    live = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = live.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("bucket")
    h = F.xxhash64(F.lit(round_), "bucket", "node")
    some = live.join(open_, "bucket", "left_semi").repartition("bucket", "node").groupBy("bucket", "comp", F.pmod(h, F.lit(DELEGATES)).alias("_share")).agg(F.min(F.struct(h.alias("h"), "tree", "tail", "node")).alias("r"))
    return some.select("bucket", "r.tree", "r.tail", "r.node", "comp")


def _block_pairs(live: DataFrame, sets: DataFrame, apart: bool) -> DataFrame:
    """Rows (bucket, node, comp) with shingles, once for each pair of blocks (x, y) of their bucket that they are in.

    Sorted by bucket, x and y; side is 1 in block y of two. With apart, pairs of one component need not meet: a component
    with more than half a block in a bucket gets blocks of its own, which do not meet each other. A bucket of BLOCK
    members at most is one block.
    """
    counts = live.groupBy("bucket", F.col("comp") if apart else F.lit(None).cast("binary").alias("comp")).agg(F.count(F.lit(1)).alias("c"))
    own = (F.col("c") > BLOCK // 2) if apart else F.lit(False)
    parts = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)).cast("int"), F.lit(1))
    hot = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.when(own, F.lit(0)).otherwise(F.col("c"))).alias("rest"), F.collect_list(F.when(own, F.struct("comp", parts(F.col("c")).alias("parts")))).alias("own"))
    hot = hot.where(F.col("n") > BLOCK).select(F.col("bucket").alias("_bucket"), parts(F.col("rest")).alias("_rest"), F.col("own").alias("_own"))
    dealt = live.join(F.broadcast(hot), live["bucket"] == F.col("_bucket"), "left")
    # a block is its owner's number (0 for all small components) times 2^20 plus its part
    owner = F.coalesce(F.array_position(F.col("_own.comp"), F.col("comp")), F.lit(0)).cast("long") if apart else F.lit(0).cast("long")
    dealt = dealt.select("bucket", "node", "comp", "_rest", "_own", owner.alias("_owner"))
    of = F.when(F.col("_owner") > 0, F.expr("try_element_at(_own, cast(_owner as int)).parts")).otherwise(F.coalesce("_rest", F.lit(1)))
    me = F.col("_owner") * (1 << 20) + F.pmod(F.xxhash64("bucket", "node"), of.cast("long"))
    blocks = F.expr("""flatten(transform(concat(array(_rest), _own.parts), (n, i) -> if(i > 0 AND i = _owner, array(), transform(sequence(0, n - 1), p -> cast(i AS BIGINT) * 1048576 + p))))""")
    dealt = dealt.select("bucket", "node", "comp", me.alias("_me"), F.when(F.col("_rest").isNull(), F.array(me)).otherwise(blocks).alias("_others"))
    dealt = dealt.select("bucket", "node", "comp", "_me", F.explode("_others").alias("_other"))
    dealt = dealt.select("bucket", F.least("_me", "_other").alias("x"), F.greatest("_me", "_other").alias("y"), (F.col("_me") > F.col("_other")).cast("int").alias("side"), "node", "comp")
    rows = dealt.join(sets.select(F.col("key").alias("node"), "shingles"), "node").select("bucket", "x", "y", "side", "node", "comp", "shingles")
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def _left_apart(members: DataFrame, comps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links a, b that join all components between which a bucket has a link."""
    live = common.stage(members.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")), "live")
    open_ = live.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("bucket")
    live = common.stage(live.join(open_, "bucket", "left_semi"), "open")
    return common.stage(_block_pairs(live, sets, True).mapInArrow(_link(threshold), "a binary, b binary").distinct(), "apart")


def _degrees(comps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links) of the nodes with links, all of which are in their component."""
    name = F.xxhash64("comp").alias("bucket")
    live = comps.select(name, "node", "comp")
    pairs = _block_pairs(live, sets, False)
    return pairs.mapInArrow(_count(threshold), "node binary, n bigint").groupBy("node").agg(F.sum("n").alias("n_links"))


def _joined(comps: DataFrame | None, near: DataFrame) -> DataFrame:
    """Components (node, comp) after more links; only what the links join is looked at again."""
    if comps is None:
        return components(near)
    to = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"_{side}"))
    ends = near.join(to("a"), "a", "left").join(to("b"), "b", "left").select("a", "b", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b"))
    ends = common.stage(ends, "ends")
    merged = components(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()).toDF("_node", "_comp")
    fresh = ends.select(F.col("a").alias("node"), F.col("_a").alias("comp")).unionByName(ends.select(F.col("b").alias("node"), F.col("_b").alias("comp")))
    every = comps.unionByName(fresh).distinct()
    return common.stage(every.join(merged, every["comp"] == merged["_node"], "left").select("node", F.coalesce("_comp", "comp").alias("comp")).distinct(), "comps")


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id and key of every row; components of the linked keys: node, comp; sets: key and shingles of the keys in buckets)."""
    k_min = prefix_length(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), _key(text).alias("key"), text.alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = common.stage(base.mapInArrow(_sketch(k_min), f"doc_id {kind}, key binary, prefixes binary, sig binary"), "sketches")
    nodes = common.stage(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("prefixes").alias("prefixes"), F.min("sig").alias("sig")), "nodes")
    members = _members(nodes, k_min)

    asked = common.stage(members.select(F.col("node").alias("key")).distinct().join(nodes.select("key", "first", "sig"), "key"), "asked")
    wanted = asked.select(F.col("key").alias("_key"), F.col("first").alias("_first"))
    texts = base.join(wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_first"))).select("key", "text")
    sets = common.stage(texts.mapInArrow(_sets, "key binary, shingles binary").dropDuplicates(["key"]), "shingles")
    sigs = asked.select(F.col("key").alias("node"), "sig")

    least = max(0.0, threshold - SLACK * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5)
    comps = None
    for k in range(DEPTH, k_min - 1, -1):
        level = _at_depth(members, k, k_min)
        live = level.where(F.col("tree") < FIRST_TREES).withColumn("comp", F.col("node")) if comps is None else _delegates(level, comps, k)
        live = common.stage(live.join(sigs, "node").select("bucket", "tree", "tail", "node", "comp", "sig"), "live")
        sizes = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).withColumnRenamed("bucket", "_bucket")
        dealt = live.join(sizes, live["bucket"] == F.col("_bucket"), "left")
        block = F.pmod(F.xxhash64(F.lit(k), "bucket", "node"), F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK)).cast("long")).cast("int")
        dealt = dealt.select("bucket", block.alias("block"), "tree", "tail", "node", "comp", "sig").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "tail")
        pairs = common.stage(dealt.mapInArrow(_propose(k_min, least), "a binary, b binary").distinct(), "pairs")
        with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
        with_b = with_a.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        near = common.stage(with_b.mapInArrow(_verify(threshold), "a binary, b binary, near boolean").where("near").select("a", "b"), "verified")
        comps = _joined(comps, near)
    return rows.select("doc_id", "key"), _joined(comps, _left_apart(members, comps, sets, threshold)), sets


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col="doc_id", text_col="text", count: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, class_size, key, class_key.

    A class holds the texts connected by links of the threshold or more; class_id is its smallest doc_id. n_links counts
    the different texts that the row's text is linked to; copies of a text share them. Without count it is null.
    """
    rows, comps, sets = links(docs, threshold, recall, id_col, text_col)
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    texts = texts.join(comps, texts["key"] == comps["node"], "left").drop("node")
    n_links = F.lit(None).cast("bigint")
    if count:
        degree = _degrees(comps, sets, threshold)
        texts, n_links = texts.join(degree, texts["key"] == degree["node"], "left"), F.coalesce("n_links", F.lit(0))
    texts = common.stage(texts.select("key", "_first", "_copies", F.coalesce("comp", "key").alias("comp"), n_links.alias("n_links")), "texts")
    named = texts.groupBy("comp").agg(F.min("_first").alias("class_id"), F.sum("_copies").alias("class_size"))
    texts = texts.join(named, "comp").select(F.col("key").alias("_key"), "class_id", "n_links", "class_size", F.col("comp").alias("class_key"))
    return rows.join(texts, rows["key"] == texts["_key"]).select("doc_id", "class_id", "n_links", "class_size", "key", "class_key")


def dedup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col="doc_id", text_col="text") -> DataFrame:
    """The row of each class with the smallest id, with the columns of docs."""
    kept = classes(docs, threshold, recall, id_col, text_col, count=False).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = kept.groupBy("class_id", "class_key").agg(F.min("key").alias("key")).select(F.col("class_id").alias("_id"), F.col("key").alias("_key"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_doc"), _key(text).alias("_text"))
    rows = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")))
    nth = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).where("_nth = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key", "class_key")
