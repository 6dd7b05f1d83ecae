"""Language-model scores by prediction by partial matching.

A byte-context trie of order ORDER is counted over all training documents. A document's symbols are the bytes of its words
(A-Z in lower case) with one space between two, then one end; contexts are the ORDER bytes before, across words, with end
bytes before the first. Counts follow update exclusion: at the longest context a symbol counts as often as it occurs, at a
shorter one once for each longer context that holds it.

In a context with total n, a symbol s seen n(s) times has (n(s) - D) / n and inherits its share of what the discounts D
leave, by the probabilities of the next shorter context; the escape is the rest of it, what that context gives to symbols
not seen here. After an escape the symbols seen are excluded and the shorter context's probabilities are scaled to the others.
Both cases come to (n(s) - D)+ / n + g * P(s | shorter context), g being the context's discounts over n, which
is how they are computed; below the empty context all 256 bytes are equal. D depends on the order and on whether a symbol
was seen once, twice or more, and is estimated from the numbers of counts 1 to 4 in the whole trie.

The trie is never gathered. Keys are 8-byte integers (ORDER context bytes and the symbol) in shards by the hash of the
three last context bytes, so that a shard holds whole subtries; words, which the base counts, are in shards of their own by
their hash. A row holds a shard's sorted keys or words and their counts as two compressed binaries. Shards are
merged and asked in streams, and what a shard holds is bounded by distinct contexts. Only contexts of up to two bytes are
sent to every task: 2^24 keys and counts (256 MiB) at the most, a few MB for text. Documents are dealt into chunks of about
CHUNK_BYTES; a chunk asks for the distinct words and keys that it holds, in a fixed order, and scores its documents from
the answers. A shard computes the probabilities of the trie's keys once, and for each chunk only those of other keys.

Defined cases: a null or word-less text has the end as its only token. Without training documents every count is 0 and
symbols are uniform over 256. Rows are scored one by one, so repeated rows and null ids keep their own results.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 6
#: Contexts up to this order are sent to every task; a shard is a set of contexts one byte longer.
LOW = 2
END = 10  # white space never occurs in a word, so a line feed can stand for the end
#: A-Z in lower case, white space as spaces.
FOLDED = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words, and keys, that a counting task holds before it passes them on.
WORDS = 200_000
KEYS = 3 << 19
#: Bytes of texts whose words are counted at once, and whose keys are built at once (these fit a processor's cache).
PIECE = 1 << 22
SLICE = 1 << 18
#: Bytes of text in a chunk: what a task holds of words, keys and answers is several times as much.
CHUNK_BYTES = 8 << 20
#: Keys, or words, of a shard that are answered at once.
ASKED = 1 << 18
#: Least and most shards, and training bytes for each between these.
SHARDS = (1 << 10, 1 << 16)
SHARD_BYTES = 1 << 30


def _body(text: bytes | None) -> bytes:
    """The words of a text with one space between two."""
    body = (text or b"").translate(FOLDED).strip(b" ")
    while b"  " in body:
        body = body.replace(b"  ", b" ")
    return body


def _words(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all bodies, each with a space behind it, and how many each body has."""
    return _split(b" ".join([*filter(None, bodies), b""])), np.array([body.count(b" ") + 1 if body else 0 for body in bodies], dtype=np.int64)


def _split(data: bytes) -> pa.Array:
    """Words of bytes that have a space behind each word."""
    stops = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1])
    return pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops), pa.py_buffer(data)])


def _joined(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The inverse of _split, and where each word starts and the last one stops."""
    if not len(words):
        return b"", np.zeros(1, dtype=np.int64)
    stops = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2][int(stops[0]) : int(stops[-1])].to_pybytes(), stops - stops[0]


def _listed(data: bytes) -> list[bytes]:
    """Words, without the spaces, of bytes that have a space behind each word."""
    return data.split(b" ")[:-1]


def _pieces(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """Bodies of texts in lists of about PIECE bytes, none cut."""
    bodies, size = [], 0
    for text in texts:
        bodies.append(_body(text))
        size += len(bodies[-1])
        if size >= PIECE:
            yield bodies
            bodies, size = [], 0
    if bodies:
        yield bodies


def _keys(texts: Iterable[bytes | None]):
    """(keys, index of the text) of the symbols of texts, in slices of about SLICE bytes."""
    pad = bytes([END]) * ORDER
    parts, index, size = [], [], 0

    def slice_():
        data = b"\0" * (7 - ORDER) + b"".join(parts)  # 8 bytes are read at each place, the last ORDER + 1 of them kept
        n = np.array([len(p) for p in parts])
        key = np.ndarray(len(data) - 7, ">i8", data, strides=(1,)).astype(np.int64)
        key &= (1 << 8 * (ORDER + 1)) - 1
        symbol = np.ones(len(data) - 7 + ORDER, dtype=bool)
        symbol[((np.cumsum(n) - n)[:, None] + np.arange(ORDER)).ravel()] = False
        return key[symbol[ORDER:]], np.repeat(index, n - ORDER)

    for i, text in enumerate(texts):
        body = _body(text) + bytes([END])
        before = pad
        for low in range(0, len(body), SLICE):
            parts.append(before + body[low : low + SLICE])
            index.append(i)
            size += len(parts[-1])
            before = body[low + SLICE - ORDER : low + SLICE]
            if size >= SLICE:
                yield slice_()
                parts, index, size = [], [], 0
    if parts:
        yield slice_()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(count[order], start) if len(key) else count


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; sorting beats the hashing of np.unique here."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _finder(keys: np.ndarray):
    """A function from keys to their places in these distinct sorted ones, all of which it knows. A table holds one key for
    each hash, a second one most of the others; the rest is searched for."""
    tables, left = [], np.arange(len(keys), dtype=np.int32)
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        factor, shift = np.uint64(factor), np.uint64(64 - (4 * len(left) + 1).bit_length())
        slot, at = np.zeros(1 << 64 - int(shift), dtype=np.int32), (keys[left].view(np.uint64) * factor >> shift).view(np.int64)
        slot[at] = left
        tables.append((factor, shift, slot))
        left = left[slot[at] != left]

    return lambda asked: _find(keys, tables, asked)


def _find(keys: np.ndarray, tables: list[tuple], asked: np.ndarray) -> np.ndarray:
    if not tables:
        return np.searchsorted(keys, asked)
    factor, shift, slot = tables[0]
    at = slot.take((asked.view(np.uint64) * factor >> shift).view(np.int64), mode="clip")  # far faster than with checks
    other = np.flatnonzero(keys.take(at, mode="clip") != asked)
    if len(other):
        at[other] = _find(keys, tables[1:], asked[other])
    return at


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """A power of two of shards, by the bytes LOW + 1 to 1 of the context."""
    context = keys >> 8 & (1 << 8 * (LOW + 1)) - 1
    return ((context.astype(np.uint32) * np.uint32(2654435761)).astype(np.uint64) * np.uint64(shards) >> np.uint64(32)).astype(np.uint16)


def _pack(x: np.ndarray) -> bytes:
    """Integers as planes of equal bytes, which compress well where they are sorted or small."""
    return zstandard.compress(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def _by_number(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by shard (16 bits, which NumPy sorts by radix), and (shard, first, stop) of each in that order."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    return order, [*zip(shard[start].tolist(), start.tolist(), [*start[1:].tolist(), len(shard)])]


def _by_word(words: pa.Array, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of distinct words by shard, then by bytes, and (shard, first, stop) of each; shards are behind those of keys."""
    listed = _listed(_joined(words)[0])
    rank = pc.sort_indices(words).to_numpy().astype(np.int64)
    order, parts = _by_number((np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) & shards - 1).astype(np.uint16)[rank])
    return rank[order], [(shards + i, low, high) for i, low, high in parts]


def _rows(keys: np.ndarray, counts: np.ndarray | None, words: pa.Array, n: np.ndarray | None, chunk: int, shards: int) -> pa.RecordBatch:
    """A row (shard, chunk, keys, vals) for each shard of sorted keys and of distinct words."""
    order, parts = _by_number(_shard(keys, shards))
    keys, counts = keys[order], None if counts is None else counts[order]
    rows = [(i, chunk, _pack(keys[low:high]), b"" if counts is None else _pack(counts[low:high])) for i, low, high in parts]
    order, parts = _by_word(words, shards)
    (data, at), n = _joined(words.take(pa.array(order))), None if n is None else n[order]
    rows += [(i, chunk, zstandard.compress(data[at[low] : at[high]], 1), b"" if n is None else _pack(n[low:high])) for i, low, high in parts]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)] if rows else [pa.nulls(0, f.type) for f in _PACKED], schema=_PACKED)


_PACKED = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
_PACKED_DDL = "shard int, chunk long, keys binary, vals binary"
_NO_KEYS, _NO_WORDS = np.zeros(0, dtype=np.int64), _split(b"")


def _word_rows(counts: Counter, shards: int) -> pa.RecordBatch:
    return _rows(_NO_KEYS, None, _split(b" ".join([*counts, b""])), np.fromiter(counts.values(), np.int64, len(counts)), -1, shards)


def _count(shards: int):
    """Batches (text) of training documents to partial counts of keys and words."""

    def run(batches):
        keys, counts, size, words = [], [], 0, Counter()
        held, raw = [], 0

        def counted():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            keys.append(key), counts.append(n), held.clear()
            return len(key)

        for bodies in _pieces(text.as_py() for b in batches for text in b.column(0)):
            code = _words(bodies)[0].dictionary_encode()
            for word, n in zip(_listed(_joined(code.dictionary)[0]), np.bincount(code.indices.to_numpy()).tolist()):
                words[word] += n
            del code
            pa.default_memory_pool().release_unused()
            if len(words) > WORDS:
                yield _word_rows(words, shards)
                words.clear()
            for key, _ in _keys(bodies):
                held.append(key)
                raw += len(key)
                if raw <= KEYS:
                    continue
                size, raw = size + counted(), 0
                if size > KEYS:
                    key, n = _summed(keys, counts)
                    keys, counts, size = [key], [n], len(key)
                    if len(key) > KEYS // 2:
                        yield _rows(key, n, _NO_WORDS, None, -1, shards)
                        keys, counts, size = [], [], 0
        if held:
            counted()
        if keys:
            yield _rows(*_summed(keys, counts), _NO_WORDS, None, -1, shards)
        if words:
            yield _word_rows(words, shards)

    return run


def _by_shard(take, done):
    """Batches of rows sorted by shard to what take(state, chunk, keys, vals) and done(state) yield; state is a new dict for
    each shard."""

    def run(batches):
        at, state = None, {}
        for b in batches:
            for shard, chunk, keys, vals in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if shard != at:
                    if at is not None:
                        yield from done(state)
                    at, state = shard, {"shard": shard}
                yield from take(state, chunk, keys.as_py(), vals.as_py())
        if at is not None:
            yield from done(state)

    return run


def _merge(shards: int):
    """Partial counts of each shard to one row."""

    def take(state, _, keys, counts):
        if state["shard"] >= shards:
            words = state.setdefault("words", Counter())
            for word, n in zip(_listed(zstandard.decompress(keys)), _unpack(counts).tolist()):
                words[word] += n
            return ()
        state.setdefault("keys", []).append(_unpack(keys)), state.setdefault("counts", []).append(_unpack(counts))
        state["size"] = state.get("size", 0) + len(state["keys"][-1])
        if state["size"] > 2 * state.get("least", KEYS // 4):
            keys, counts = _summed(state["keys"], state["counts"])
            state.update(keys=[keys], counts=[counts], size=len(keys), least=max(KEYS // 4, len(keys)))
        return ()

    def done(state):
        if state["shard"] >= shards:
            yield _word_rows(state["words"], shards)
        else:
            yield _rows(*_summed(state["keys"], state["counts"]), _NO_WORDS, None, -1, shards)

    return _by_shard(take, done)


def _levels(keys: np.ndarray, counts: np.ndarray, order: int, least: int) -> dict:
    """{order: (keys, counts)} of the orders from order down to least, with update exclusion below the first."""
    out = {order: (keys, counts)}
    for j in range(order - 1, least - 1, -1):
        out[j] = np.unique(out[j + 1][0] & (1 << 8 * (j + 1)) - 1, return_counts=True)
    return out


def _numbers(levels: dict) -> dict:
    """{(order, r): how many keys of that order have count r}, r from 1 to 4."""
    return {(j, r): int((n == r).sum()) for j, (_, n) in levels.items() for r in (1, 2, 3, 4)}


#: Numbers of a summary besides counts of counts: words, distinct words.
_TOTAL, _DISTINCT = -1, -2


def _summary(shards: int):
    """Shards to (key, n): the keys of order LOW with their counts, -4 * order - r for the numbers of counts r, and words."""

    def run(batches):
        for b in batches:
            for shard, keys, counts in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                counts = _unpack(counts.as_py())
                if shard >= shards:
                    out = {_TOTAL: int(counts.sum()), _DISTINCT: len(counts)}
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out.keys(), out.values())], names=["key", "n"])
                    continue
                levels = _levels(_unpack(keys.as_py()), counts, ORDER, LOW)
                low, n = levels.pop(LOW)
                numbers = _numbers(levels)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-4 * j - r for j, r in numbers], low])), pa.array(np.concatenate([[*numbers.values()], n]))], names=["key", "n"])

    return run


def discounts(numbers: dict) -> dict:
    """D of symbols seen once, twice and more often for each order."""
    out = {}
    for j in {j for j, _ in numbers}:
        n = [numbers[j, r] for r in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        out[j] = np.array([min(max(r - (r + 1) * y * n[r] / max(1, n[r - 1]), 0.05), r - 0.02) for r in (1, 2, 3)])
    return out


def _prepared(levels: dict, discount: dict) -> list[tuple]:
    """(order, keys, what each has of its context's own, contexts, what each leaves to the shorter one), by order."""
    out = []
    for j in sorted(levels):
        keys, n = levels[j]
        if not len(keys):
            continue
        context = keys >> 8
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        total = np.add.reduceat(n, start)
        d = discount[j][np.minimum(n, 3) - 1]
        own = (n - d) / np.repeat(total, np.diff(np.append(start, len(keys))))
        out.append((j, keys, own, context[start], np.add.reduceat(d, start) / total))
    return out


def _probabilities(asked: np.ndarray, p: np.ndarray, prepared: list[tuple]) -> np.ndarray:
    """Probabilities of the asked keys, from those in the context below the first of the levels, climbing to the last."""
    for j, keys, own, contexts, left in prepared:
        want = asked & (1 << 8 * (j + 1)) - 1
        node = np.minimum(np.searchsorted(contexts, want >> 8), len(contexts) - 1)
        leaf = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        p = np.where(contexts[node] == want >> 8, np.where(keys[leaf] == want, own[leaf], 0.0) + left[node] * p, p)
    return p


def _answer(low: dict, discount: dict, shards: int):
    """Shards and, behind each, what chunks ask of it to rows (chunk, shard, vals): logarithms of probabilities, or counts."""
    short = _prepared(low, discount)

    def logarithms(state, asked):
        prepared = [*short, *state.get("long", [])]
        return np.log10(_probabilities(asked, np.full(len(asked), 1 / 256), prepared)).astype(np.float32)

    def values(state, asked):
        """What is asked for is mostly in the trie, of whose keys each is computed once, whoever asks for it."""
        if "keys" not in state:
            return logarithms(state, asked)
        if "known" not in state:
            state["known"] = logarithms(state, state["keys"])
        leaf = np.minimum(np.searchsorted(state["keys"], asked), len(state["keys"]) - 1)
        out, other = state["known"][leaf], np.flatnonzero(state["keys"][leaf] != asked)
        if len(other):
            out[other] = logarithms(state, asked[other])
        return out

    def told(state):
        chunks, asked = state.pop("chunks", []), state.pop("asked", [])
        state["size"] = 0
        if not chunks:
            return
        if state["shard"] >= shards:
            known = state.get("words", {})
            vals = [_pack(np.array([known.get(w, 0) for w in words], dtype=np.int64)) for words in asked]
        else:
            stops = np.cumsum([len(keys) for keys in asked])
            vals = [x.tobytes() for x in np.split(values(state, np.concatenate(asked)), stops[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([state["shard"]] * len(chunks), pa.int32()), pa.array(vals, pa.binary())], names=["chunk", "shard", "vals"])

    def take(state, chunk, keys, counts):
        words = state["shard"] >= shards
        keys = _listed(zstandard.decompress(keys)) if words else _unpack(keys)
        if chunk >= 0:
            state.setdefault("chunks", []).append(chunk), state.setdefault("asked", []).append(keys)
            state["size"] = state.get("size", 0) + len(keys)
            if state["size"] >= ASKED:
                yield from told(state)
        elif words:
            state["words"] = dict(zip(keys, _unpack(counts).tolist()))
        else:
            state["keys"], state["long"] = keys, _prepared(_levels(keys, _unpack(counts), ORDER, LOW + 1), discount)

    return _by_shard(take, told)


class Model:
    """counts: one row a shard, staged; docs: training documents; shards: of keys, and as many of words."""

    def __init__(self, counts: DataFrame, docs: int, shards: int):
        self.counts, self.docs, self.shards = counts, docs, shards


def train(docs: DataFrame, text_col="text") -> Model:
    text = docs.select(F.col(text_col).cast("binary").alias("text"))
    size = text.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = min(SHARDS[1], max(SHARDS[0], 1 << ((size.bytes or 0) // SHARD_BYTES).bit_length()))
    parts = text.mapInArrow(_count(shards), _PACKED_DDL).repartition("shard").sortWithinPartitions("shard")
    return Model(common.stage(parts.mapInArrow(_merge(shards), _PACKED_DDL), "trie"), size.n, shards)


def _needed(bodies: list[bytes]) -> np.ndarray:
    """The distinct keys of texts, sorted."""
    keys, held = _NO_KEYS, []
    for key, _ in _keys(bodies):
        held.append(_distinct(key))
        if sum(map(len, held)) > KEYS:
            keys, held = _distinct(np.concatenate([keys, *held])), []
    return _distinct(np.concatenate([keys, *held]))


def _ask(shards: int):
    """What a chunk needs of each shard."""

    def run(table):
        bodies = [_body(text) for text in table["text"].to_pylist()]
        return pa.Table.from_batches([_rows(_needed(bodies), None, _words(bodies)[0].unique(), None, table["chunk"][0].as_py(), shards)])

    return run


def _score_chunk(total: int, distinct: int, end: int, shards: int, out: pa.Schema):
    def run(docs, answers):
        if not docs.num_rows:
            return out.empty_table()
        bodies = [_body(text) for text in docs["text"].to_pylist()]
        got = sorted(zip(answers["shard"].to_pylist(), answers["vals"].to_pylist()))  # in the order in which it was asked
        words, n = _words(bodies)
        words = words.dictionary_encode()
        count = np.empty(len(words.dictionary), dtype=np.int64)
        if len(count):
            count[_by_word(words.dictionary, shards)[0]] = np.concatenate([_unpack(x) for i, x in got if i >= shards])
        code, owner = words.indices.to_numpy(), np.repeat(np.arange(len(bodies)), n)
        base = np.log10((count + 1.0) / (total + distinct + 1.0))
        base_sum = np.bincount(owner, weights=base[code], minlength=len(bodies)) + math.log10((end + 1) / (total + distinct + 1))
        seen = np.bincount(owner, weights=count[code] > 0, minlength=len(bodies)).astype(np.int64) + (end > 0)
        del words, count, base, code, owner
        pa.default_memory_pool().release_unused()
        keys = _needed(bodies)
        logp = np.empty(len(keys))
        logp[_by_number(_shard(keys, shards))[0]] = np.frombuffer(b"".join(x for i, x in got if i < shards), np.float32)
        del got
        score, find = np.zeros(len(bodies)), _finder(keys)
        for key, owner in _keys(bodies):
            first, last = owner[0], owner[-1]
            score[first : last + 1] += np.bincount(owner - first, weights=logp.take(find(key), mode="clip"))
        return pa.table([docs["doc_id"], docs["held_out"], pa.array(n + 1), pa.array(seen), pa.array([total] * len(bodies), pa.int64()), pa.array(base_sum), pa.array(score)], schema=out)

    return run


def score(docs: DataFrame, model: Model, held_out: Column, id_col="doc_id", text_col="text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of all rows of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    told = model.counts.mapInArrow(_summary(model.shards), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = told["key"].to_numpy(), told["n"].to_numpy()
    few = dict(zip(key[key < 0].tolist(), n[key < 0].tolist()))
    numbers = {(j, r): few.get(-4 * j - r, 0) for j in range(LOW + 1, ORDER + 1) for r in (1, 2, 3, 4)}
    some = np.flatnonzero(key >= 0)
    some = some[np.argsort(key[some])]
    low = _levels(key[some], n[some], LOW, 0)
    discount = discounts(numbers | _numbers(low))
    total, distinct = few.get(_TOTAL, 0) + model.docs, few.get(_DISTINCT, 0) + (model.docs > 0)

    text = F.col(text_col).cast("binary")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.crc32(text)), F.lit(chunks)).alias("chunk"))
    asked = dealt.groupBy("chunk").applyInArrow(_ask(model.shards), _PACKED_DDL)
    shards = model.counts.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "chunk")
    shared, number = docs.sparkSession.sparkContext.broadcast((low, discount)), model.shards

    def answers_of(batches):
        yield from _answer(*shared.value, number)(batches)

    answers = shards.mapInArrow(answers_of, "chunk long, shard int, vals binary")
    kind = dealt.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = pa.schema([(f.name, f.type) for f in common.arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)])
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(total, distinct, model.docs, model.shards, out), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.fold(F.col("doc_id"), 7) == 2
    return score(docs, train(docs.where(~held_out)), held_out)
