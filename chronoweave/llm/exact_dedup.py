"""Exact deduplication by Patricia-trie owners.

Texts are dealt by length and content hash. Each task inserts the full byte strings into a compressed radix trie whose
terminal nodes hold the owner (the smallest or largest identifier), the owner's row and the number of copies. A trie
over its budget spills its largest subtree to a temporary file, and that subtree is built later on its own. A combining
trie runs before the shuffle, so a text that fills a third of the corpus is sent once for each input task.

Defined cases: a null text equals the empty text. Null ids lose against any id. Of rows that repeat both the owner's
id and its text, one stays. Two texts are equal only when their bytes are; assign() hands the owners' decision to the rows
by SHA-256, and those of texts with more than 1 / HOT of all rows (HOT - 1 at most) by broadcast, so that no join key
is hot. An empty table gives no rows; other columns are carried unchanged.
"""

from __future__ import annotations

import pickle
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BUDGET = 96 << 20
OUT_BYTES = 8 << 20
HOT = 1000


class _Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.kids, self.value = label, {}, value


class _Spilled:
    __slots__ = ("file",)

    def __init__(self):
        self.file = tempfile.TemporaryFile()


def _shared(a: bytes, at: int, b: bytes) -> int:
    """Length of the common prefix of a[at:] and b, which differ or of which one ends."""
    low, high = 0, min(len(a) - at, len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[at + low : at + mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Compressed trie of byte strings; merge(old, new) gives a key's value when it comes again."""

    def __init__(self, merge, budget: int = BUDGET):
        self.root, self.merge, self.budget, self.size, self.keys = _Node(b""), merge, budget, 0, 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.value is None:
                    node.value, self.keys = value, self.keys + 1
                else:
                    node.value = self.merge(node.value, value)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = _Node(key[at:], value)
                self.size, self.keys = self.size + len(key) - at + 200, self.keys + 1
                return
            if isinstance(kid, _Spilled):
                pickle.dump((key, value), kid.file, pickle.HIGHEST_PROTOCOL)
                return
            label = kid.label
            if not key.startswith(label, at):
                n = _shared(key, at, label)
                middle = _Node(label[:n])
                kid.label = label[n:]
                middle.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = middle
            node, at = kid, at + len(kid.label)

    def spill(self) -> None:
        """Move the largest subtree below the first fork to a file."""
        if self.keys < 2:
            return
        node, prefix = self.root, b""
        while len(node.kids) == 1 and node.value is None and isinstance(kid := next(iter(node.kids.values())), _Node):
            node, prefix = kid, prefix + kid.label
        sizes = {b: sum(len(k) + 200 for k, _ in self._walk(kid, b"")) for b, kid in node.kids.items() if isinstance(kid, _Node)}
        if not sizes:
            return
        most = max(sizes, key=sizes.get)
        out = _Spilled()
        for key, value in self._walk(node.kids[most], prefix):
            pickle.dump((key, value), out.file, pickle.HIGHEST_PROTOCOL)
            self.keys -= 1
        todo = [node.kids[most]]
        while todo:  # what was spilled from the subtree before goes along
            inner = todo.pop()
            if isinstance(inner, _Spilled):
                inner.file.seek(0)
                shutil.copyfileobj(inner.file, out.file)
                inner.file.close()
            else:
                todo.extend(inner.kids.values())
        node.kids[most] = out
        self.size = max(0, self.size - sizes[most])

    def _walk(self, top: _Node, prefix: bytes):
        todo = [(top, prefix)]
        while todo:
            node, prefix = todo.pop()
            if isinstance(node, _Spilled):
                continue
            key = prefix + node.label
            if node.value is not None:
                yield key, node.value
            todo.extend((kid, key) for kid in node.kids.values())

    def items(self):
        """All (key, value); subtrees in files are read back one at a time."""
        yield from self._walk(self.root, b"")
        todo = [self.root]
        while todo:
            node = todo.pop()
            if not isinstance(node, _Spilled):
                todo.extend(node.kids.values())
                continue
            node.file.seek(0)
            below = RadixTrie(self.merge, self.budget)
            while True:
                try:
                    below.insert(*pickle.load(node.file))
                except EOFError:
                    break
                if below.size > below.budget:
                    below.spill()
            node.file.close()
            yield from below.items()


def _owners(schema: pa.Schema, largest: bool, combine: bool, budget: int):
    """Arrow batches (n_bytes, sha, key, id, copies[, row]) to one row for each text of the task.

    combine: the task only thins its rows, so a full trie is passed on at once instead of being spilled.
    """

    def better(old, new):
        a, b = old[0], new[0]
        wins = b is not None and (a is None or (b > a if largest else b < a))
        first = new if wins else old
        return (first[0], old[1] + new[1], first[2], first[3])

    def rows(trie):
        out, size = [], 0
        for key, (ident, copies, sha, row) in trie.items():
            out.append((len(key), sha, key, ident, copies, row))
            size += len(key) + 200
            if size > OUT_BYTES:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out), schema)], schema=schema)

    def run(batches):
        trie = RadixTrie(better, budget)
        for b in batches:
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            row = cols["row"].to_pylist() if "row" in cols else [None] * b.num_rows
            for sha, key, ident, copies, r in zip(cols["sha"].to_pylist(), cols["key"], cols["id"].to_pylist(), cols["copies"].to_pylist(), row):
                trie.insert(key.as_py(), (ident, copies, sha, r))
                if trie.size > budget:
                    if combine:
                        yield from rows(trie)
                        trie = RadixTrie(better, budget)
                    else:
                        trie.spill()
        yield from rows(trie)

    return run


def owners(docs: DataFrame, keep: str = "smallest", id_col="doc_id", text_col="text", carry: Column | None = None, budget: int = BUDGET) -> DataFrame:
    """One row for each distinct text: n_bytes, sha, key (the bytes), id (of the owner), copies, and row if carried."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    cols = [F.octet_length(text).alias("n_bytes"), F.sha2(text, 256).alias("sha"), text.alias("key"), F.col(id_col).alias("id"), F.lit(1).cast("long").alias("copies")]
    dealt = docs.select(*cols, *([carry.alias("row")] if carry is not None else []))
    schema = common.arrow_schema(dealt.schema)
    schema = pa.schema([pa.field(f.name, f.type) for f in schema])
    thin = dealt.mapInArrow(_owners(schema, keep == "largest", True, budget), dealt.schema)
    return thin.repartition("n_bytes", "sha").mapInArrow(_owners(schema, keep == "largest", False, budget), dealt.schema)


def assign(docs: DataFrame, keep: str = "smallest", id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    classes = owners(docs, keep, id_col, text_col).select(F.col("sha").alias("_sha"), F.col("id").alias("_id"), F.col("copies").alias("_n"))
    classes = common.stage(classes, "owners")
    total = classes.agg(F.sum("_n")).first()[0] or 0
    hot = classes.where(F.col("_n") * HOT > total).toDF("_hot", "_hot_id", "_hot_n")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    each = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    each = each.join(F.broadcast(hot), each["text_sha256"] == F.col("_hot"), "left")
    key = F.when(F.col("_hot").isNull(), F.col("text_sha256")).otherwise(F.xxhash64("doc_id").cast("string"))  # spread, and no hash
    each = each.withColumn("_key", key).join(classes, F.col("_key") == F.col("_sha"), "left")
    found = lambda hot, other: F.when(F.col("_hot").isNotNull(), F.col(hot)).otherwise(F.col(other))
    each = each.select("doc_id", found("_hot_id", "_id").alias("keep_id"), found("_hot_n", "_n").alias("group_size"), "text_sha256")
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("keep_id")) == 1
    return each.repartition("doc_id", "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256"
    )


def dedup(docs: DataFrame, keep: str = "smallest", id_col="doc_id", text_col="text") -> DataFrame:
    """The owners' rows with all columns of docs. Texts are shuffled once; nothing is joined back."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], F.col(text_col).isNull().alias("none"))
    got = owners(docs, keep, id_col, text_col, row)
    back = F.when(~F.col("row.none"), F.col("key").cast("string"))
    return got.select(*[back.alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.read_table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
