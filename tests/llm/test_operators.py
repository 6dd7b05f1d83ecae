"""Edge cases and brute-force checks of the corpus operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import ann, common, exact_dedup, jaccard, langid, lm_ppm, mixing, packing, pii, toxicity, warc
from chronoweave.llm.components import components

from .conftest import LONG, ROWS

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        over = [s for s in names if s not in full and left * w[s] / sum(w[x] for x in names if x not in full) > cap * sizes[s] + 1e-9]
        if not over:
            return {s: cap * sizes[s] if s in full else left * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        full.update(over)


def test_mixing_targets_and_limits(spark):
    got = mixing.query(spark, SF).collect()
    docs = documents(spark).collect()
    sizes, of = defaultdict(int), {}
    for r in docs:
        of[r.doc_id] = (r.source, len(WORD.findall(r.text or "")))
        sizes[r.source] += of[r.doc_id][1]
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        source, size = of[r.doc_id]
        assert r.size == size and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken % max(1, size) == 0 and r.taken <= 2 * size
        taken[source] += r.taken
    largest = defaultdict(int)
    for source, size in of.values():
        largest[source] = max(largest[source], size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.query(spark, SF).collect()))


def test_mixing_expectation(spark):
    docs = spark.createDataFrame([(i, " ".join("w" * (1 + i % 7)), "a") for i in range(60)], "doc_id bigint, text string, source string")
    sums = Counter()
    for seed in range(30):
        for r in mixing.copies(docs, share=0.5, seed=seed).collect():
            sums[r.doc_id] += r.copies
    assert 0.42 < sum(sums.values()) / (30 * 60) < 0.58


def test_mixing_edges(spark, edge, empty):
    got = mixing.copies(edge).collect()
    assert sum(r.copies_of for r in got) == len(ROWS)
    assert {r.size for r in got if r.doc_id in (3, 4, 7)} == {0}
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    copies = {(r.doc_id, r.source, r.size): r.copies for r in got}
    assert mixed.count() == sum(copies[r[0], r[3], len(WORD.findall(r[1] or ""))] for r in ROWS)
    assert mixing.mix(empty).count() == 0 and mixing.copies(empty).count() == 0


def test_mixing_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.createDataFrame([(i, " ".join("w" * (1 + i * 7 % 13)), "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string")
    got = mixing.copies(docs, weights=(1.0, 3.0), share=1.1).collect()
    for s in "ab":
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in rows) - rows[0].target) <= 13


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 500])
def test_trie_against_dict(budget):
    rng = random.Random(budget)
    trie, want = exact_dedup.RadixTrie(lambda a, b: a + b, budget), Counter()
    for _ in range(600):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) + b"x" * rng.randrange(3) * 20
        want[key] += 1
        trie.insert(key, 1)
        if trie.size > trie.budget:
            trie.spill()
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want


def test_dedup_edges(spark, edge, empty):
    got = exact_dedup.assign(edge, keep="largest", id_col="doc_id").collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({r[1] or "" for r in ROWS})
    for r in got:
        same = [x for x in ROWS if hashlib.sha256((x[1] or "").encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((x[0] for x in same if x[0] is not None), default=None)
    kept = exact_dedup.dedup(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({x[1] or "" for x in ROWS})
    assert {r.doc_id for r in rows if r.text == ROWS[0][1]} == {1} and all(r.size.startswith("size") for r in rows)
    assert exact_dedup.assign(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0
    small = exact_dedup.owners(edge, budget=1000).collect()
    assert sorted(bytes(r.key) for r in small) == sorted({(x[1] or "").encode() for x in ROWS})


# ---------------------------------------------------------------- language model


def brute_ppm(train, text, order):
    """log10 probability of a text straight from the definition: escapes with exclusion, symbol by symbol."""
    stream = lambda t: b"\n" * order + b" ".join((t or "").encode().lower().split()) + b"\n"
    nodes = [defaultdict(Counter) for _ in range(order + 1)]
    for t in map(stream, train):
        for i in range(order, len(t)):
            nodes[order][t[i - order : i]][t[i]] += 1
    for j in range(order - 1, -1, -1):  # update exclusion
        for context, symbols in nodes[j + 1].items():
            for s in symbols:
                nodes[j][context[1:]][s] += 1
    discount = []
    for level in nodes:
        n = [sum(c == r for symbols in level.values() for c in symbols.values()) for r in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        discount.append([min(max(r - (r + 1) * y * n[r] / max(1, n[r - 1]), 0.05), r - 0.02) for r in (1, 2, 3)])

    def distribution(context, j):
        if j < 0:
            return [1 / 256] * 256
        lower, node = distribution(context[1:], j - 1), nodes[j].get(context)
        if not node:
            return lower
        d = {s: discount[j][min(n, 3) - 1] for s, n in node.items()}
        total, left = sum(node.values()), sum(d.values())
        p = {s: (n - d[s]) / total + left / total * lower[s] for s, n in node.items()}
        escape, others = 1 - sum(p.values()), 1 - sum(lower[s] for s in node)
        return [p[s] if s in p else escape * lower[s] / others for s in range(256)]

    t = stream(text)
    return sum(math.log10(distribution(t[i - order : i], order)[t[i]]) for i in range(order, len(t)))


def test_lm_against_definition(spark, monkeypatch):
    texts = ["the cat sat on the mat", "The dog sat", "a cataract of cats", "", "zebra the", None, "the cat sat on  the dog\t", "é the \u00a0 dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    train = docs.where("doc_id < 4")
    counts = Counter(w for t in texts[:4] for w in [*t.lower().split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    for keys in (lm_ppm.KEYS, 4):
        monkeypatch.setattr(lm_ppm, "KEYS", keys)
        got = {r.doc_id: r for r in lm_ppm.score(docs, lm_ppm.train(train), F.col("doc_id") >= 4, chunk_bytes=16).collect()}
        for i, text in enumerate(texts):
            assert got[i].score == pytest.approx(brute_ppm(texts[:4], text, lm_ppm.ORDER))
            tokens = [w.decode() for w in [*(text or "").lower().encode().split(), b"\n"]]
            assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(tokens), sum(counts[w] > 0 for w in tokens), n, i >= 4)


def test_lm_is_a_distribution():
    """The probabilities of all symbols in a context sum to 1, seen or not."""
    keys = [np.unique(k, return_counts=True) for k, _ in lm_ppm._keys([b"abracadabra abra", b"cad bra", b""])]
    levels = lm_ppm._levels(*keys[0], lm_ppm.ORDER, 0)
    discount = lm_ppm.discounts(lm_ppm._numbers(levels))
    for context in (b"cadabr", b"xxxabr", b"zzzzzz", b"\n\n\n\n\n\n"):
        asked = (int.from_bytes(context, "big") << 8) + np.arange(256)
        p = lm_ppm._probabilities(asked, np.full(256, 1 / 256), lm_ppm._prepared(levels, discount))
        assert p.min() > 0 and p.sum() == pytest.approx(1)


def test_lm_keys_by_slice(monkeypatch):
    """Contexts cross words and reach back ORDER bytes, also where a long text is cut."""
    texts = [b"Ab c", b"", None, LONG.encode()[:900]]
    whole = [(key.tolist(), owner.tolist()) for key, owner in lm_ppm._keys(texts)]
    assert len(whole) == 1 and whole[0][0][4] == int.from_bytes(b"\n\nab c\n", "big") and whole[0][1][4:7] == [0, 1, 2]
    monkeypatch.setattr(lm_ppm, "SLICE", 50)
    parts = [*zip(*((key.tolist(), owner.tolist()) for key, owner in lm_ppm._keys(texts)))]
    assert [sum(x, []) for x in parts] == [*whole[0]]


def test_lm_known_keys_are_computed_once(monkeypatch):
    """However many chunks ask for a key of the trie, its probability is computed once; all answers are as computed alone."""
    counted = pa.Table.from_batches(lm_ppm._count(1)([pa.record_batch({"text": [b"abracadabra abra", b"cad bra", None]})]))
    asked = [lm_ppm._ask(1)(pa.table({"text": [b"Abra  zebra"], "chunk": [i]})) for i in range(20)]
    trie = [lm_ppm._unpack(counted[c][0].as_py()) for c in ("keys", "vals")]
    levels = lm_ppm._levels(*trie, lm_ppm.ORDER, 0)
    discount = lm_ppm.discounts(lm_ppm._numbers(levels))
    sizes, compute = [], lm_ppm._probabilities
    monkeypatch.setattr(lm_ppm, "_probabilities", lambda keys, *a: sizes.append(len(keys)) or compute(keys, *a))
    rows = pa.concat_tables([counted, *asked]).sort_by([("shard", "ascending"), ("chunk", "ascending")])
    got = pa.Table.from_batches(lm_ppm._answer({j: levels[j] for j in range(lm_ppm.LOW + 1)}, discount, 1)(rows.to_batches()))
    keys = lm_ppm._unpack(asked[0]["keys"][0].as_py())
    other = len(np.setdiff1d(keys, trie[0]))
    assert 0 < other < len(keys) and sum(sizes) <= len(trie[0]) + 20 * other
    alone = np.log10(compute(keys, np.full(len(keys), 1 / 256), lm_ppm._prepared(levels, discount))).astype(np.float32)
    for shard, expected in ((0, alone.tolist()), (1, [1, 0])):  # abra is a word of the training texts
        answers = [(r["chunk"], r["vals"]) for r in got.to_pylist() if r["shard"] == shard]
        assert sorted(c for c, _ in answers) == [*range(20)]
        assert all((lm_ppm._unpack(v) if shard else np.frombuffer(v, np.float32)).tolist() == expected for _, v in answers)


def test_lm_words_and_places():
    """Bodies, words and places of keys are those of plain Python, also where hashes collide."""
    texts = [None, b"", b" \t\r\n\x0b\x0c", b"  A\tb  C ", "É\u00a0é \x00\x1f\u2028x".encode(), b"a" * 999 + b" " * 999 + b"Z"]
    bodies = [lm_ppm._body(t) for t in texts]
    assert bodies == [b" ".join((t or b"").lower().split()) for t in texts]
    words, n = lm_ppm._words(bodies)
    assert [w.as_py() for w in words] == [w + b" " for b in bodies for w in b.split()] and n.tolist() == [len(b.split()) for b in bodies]
    for size in (0, 1, 2, 50_000):
        keys = np.unique(np.random.default_rng(size).integers(0, 1 << 56, size))
        asked = np.random.default_rng(1).permutation(np.repeat(keys, 2))
        assert (lm_ppm._finder(keys)(asked) == np.searchsorted(keys, asked)).all()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_lm_beats_base_on_held_out(spark, sf):
    got = lm_ppm.query(spark, f"/root/testdata/sf{sf}").where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.max("score").alias("most")).first()
    assert got.score > got.base and got.most < 0


def test_lm_edges(spark, edge, empty):
    rows = lm_ppm.score(edge, lm_ppm.train(edge.where("doc_id < 6")), F.lit(False)).collect()
    assert len(rows) == len(ROWS) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 7)} == {1}
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    bare = lm_ppm.score(edge, lm_ppm.train(empty), F.lit(True)).collect()
    assert len(bare) == len(ROWS) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in bare)
    assert lm_ppm.score(empty, lm_ppm.train(edge), F.lit(True)).count() == 0


# ---------------------------------------------------------------- packing


def check_packing(rows, lengths, capacity):
    """Gapless sequences within the capacity that hold all pieces; returns their number."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(lengths)
    return len(by_sequence)


def test_packing_against_tokenizer(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.query(spark, SF).collect()
    ids = {r.doc_id: np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in documents(spark).collect()}
    n = check_packing(rows, [len(x) for x in ids.values()], packing.CAPACITY)
    assert n <= math.ceil(sum(map(len, ids.values())) / packing.CAPACITY) * 1.02 + 1
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.length == packing.CAPACITY or r.piece == 0


def test_packing_edges(spark, edge, empty):
    rows = packing.pack(edge).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1]
    encode = packing.encoder(packing.default_tokenizer())
    check_packing(rows, [len(encode(r[1] or "")) + 1 for r in ROWS], packing.CAPACITY)
    assert packing.pack(empty).count() == 0
    small = packing.pack(edge, capacity=16, groups=4).collect()
    check_packing(small, [len(encode(r[1] or "")) + 1 for r in ROWS], 16)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    rng = random.Random(5)
    alphabet = "ab é\n\t'sßЖ中😀  ٣½ .,!?<|>_1"
    for text in ["", LONG[:5000], "<|endoftext|> x", *("".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300))]:
        assert list(encode(text)) == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_packing_plans(seed):
    rng = random.Random(seed)
    hist = Counter(rng.randrange(1, 100) for _ in range(rng.randrange(1, 400)))
    large = {k: n for k, n in hist.items() if k > 12}
    first, q, places, n = packing.plan_large(large, 100, 8)
    order = [k for k in sorted(large, reverse=True) for _ in range(large[k])]
    bins = defaultdict(int)
    for g, low, high, base, per in places:
        for i in range(low, high):
            bins[base + (i - low) // per] += order[g * q + i]
    assert len(bins) == n and all(used <= 100 for used in bins.values()) and sum(bins.values()) == sum(order)
    spaces = Counter(100 - used for used in bins.values() if used < 100)
    small = {k: c for k, c in hist.items() if k <= 12}
    _, places, fresh = packing.plan_small(spaces, small, 100)
    left = dict(enumerate(s for s in sorted(spaces) for _ in range(spaces[s])))
    for length, low, high, base, per, space in places:
        for i in range(low, high):
            rank = base + (i - low) // per
            assert left.setdefault(rank, 100) >= length and space - (i - low) % per * length == left[rank]
            left[rank] -= length
    assert sum(high - low for _, low, high, *_ in places) == sum(small.values()) and len(left) == sum(spaces.values()) + fresh


# ---------------------------------------------------------------- nearest neighbours


def test_ann_recall_and_edges(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    ids = np.array([r.vec_id for r in rows])
    cos = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    found = defaultdict(set)
    for r in ann.query(spark, "/root/testdata/sf0.01").collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in (ids % 50 == 0).nonzero()[0]:
        score = np.where(ids == ids[q], -2, cos[q])
        hits += len(found[ids[q]] & set(ids[np.lexsort((ids, -score))[:5]]))
    assert hits / (5 * len(found)) >= 0.95
    bad = [(0, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, [1.0, 1.0], "x"), (2, [1.0, 1.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [float("nan"), 1.0], "x"), (6, [None, 1.0], "x"), (7, [], "x"), (None, [1.0, 0.0], "x"), (50, [1.0, 2.0, 3.0], "x"), (8, [float("inf"), 0.0], "x"), (9, [3.0, 0.0], "x")]
    frame = spark.createDataFrame(bad, "vec_id bigint, embedding array<double>, norm string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(ann.index(frame), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 2, 0.707107), (0, 4, 2, 0.707107)]
    assert ann.search(ann.index(frame.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- PII


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


CHECKS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in CHECKS.items() for m in re.finditer(p, text or "") if ok(m.group())]


def test_pii_base_against_re(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", " ", "4111111111111111", "12", "256", "1", "+1", "(555)", "é", "😀", "x_y", "@d.com", "..", "%", "0001", "37828224631000 5", "+", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)] + [r[1] for r in ROWS] + ["1." * 5000, "1 " * 5000, "a.b" * 3000 + "@c" + ".d" * 3000, "+1" + " 2" * 4000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, base string")
    for r in pii.detect(docs).select("doc_id", pii.digest(F.col("base")).alias("b"), pii.digest(F.col("spans")).alias("s")).collect():
        want = base_spans(texts[r.doc_id])
        assert r.b == ",".join(want), texts[r.doc_id][:80]
        assert set(want) <= set(r.s.split(",") if r.s else [])


def test_pii_query(spark, empty):
    for r in pii.query(spark, SF).join(documents(spark).select("doc_id", "text"), "doc_id").collect():
        want = base_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in CHECKS]
    assert pii.detect(empty.select("doc_id", "text")).count() == 0


def test_pii_adds_what_the_patterns_miss(spark):
    """Formats outside the base patterns are added where evidence is likely, and look-alikes are left alone."""
    rng = random.Random(12)

    def card(n, valid):
        while True:
            x = "3" + "".join(rng.choice("0123456789") for _ in range(n - 1))
            if luhn(x) == valid:
                return x

    rows, want = [], {}
    for i in range(400):
        kind = i % 5
        if kind == 0:
            c = card(15, True)
            text, span = f"paid with card: {c[:4]} {c[4:10]} {c[10:]} today", f"{c[:4]} {c[4:10]} {c[10:]}"
        elif kind == 1:
            text, span = f"please call {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} now", None
            span = re.search(r"[0-9-]+", text).group()
        elif kind == 2:
            text = f"write to user{i} [at] host{i % 7} [dot] com soon"
            span = f"user{i} [at] host{i % 7} [dot] com"
        elif kind == 3:
            text, span = f"serial no {card(15, bool(i % 9 == 0))} in stock", None
        else:
            text, span = f"it ran at {i % 24:02d}:{i % 60:02d}:{i % 59:02d} me@noon.Then more", None
        rows.append((i, text))
        want[i] = span
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in pii.detect(docs).collect():
        text = rows[r.doc_id][1]
        base = {(s.start, s.stop) for s in r.base}
        added = [text[s.start : s.stop] for s in r.spans if (s.start, s.stop) not in base]
        assert added == ([want[r.doc_id]] if want[r.doc_id] else []), text


def test_pii_edges(spark, edge):
    rows = pii.detect(edge)
    assert rows.count() == len(ROWS) and "text" not in rows.columns
    plain = spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co"), (1, None)], "doc_id bigint, text string")
    assert sorted(str([tuple(s) for s in r.spans]) for r in pii.detect(plain).collect()) == ["[(0, 0, 6)]", "[(0, 0, 6)]", "[]"]


def test_isotonic():
    assert pii.isotonic([(0.1, 9, 0), (0.2, 9, 9), (0.3, 9, 0), (0.4, 9, 9)]) == [(0.1, 0.05), (0.2, 9.5 / 19), (0.4, 0.95)]
    cells = [((1 << len(pii.FEATURES)) | b, fold, 40, 40 if b else 1) for b in (0, 1) for fold in range(pii.FOLDS)]
    least = pii.thresholds(cells)
    model = pii.boost([(c[0], 200, 200 if c[0] & 1 else 5) for c in cells if c[1] == 0])
    one = 1 << len(pii.FEATURES)
    assert pii._score(one, model) < least[0] <= pii._score(one | 1, model) + 0.5 and least[1:] == [float("inf")] * 3


def test_boosting_separates():
    cells = [(b, 50, 50 if b & 1 and not b & 4 else 2) for b in range(16)]
    model = pii.boost(cells)
    assert min(pii._score(b, model) for b, _, y in cells if y == 50) > max(pii._score(b, model) for b, _, y in cells if y == 2)


# ---------------------------------------------------------------- language ID


def test_langid_accuracy_and_edges(spark, edge, empty):
    got = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    model = langid.train(edge)
    rows = langid.identify(edge, model)
    assert rows.columns == [*edge.columns, "lang_pred", "lang_score", "lang_fit"]
    assert langid.identify(rows, model).columns == [*rows.columns, "_lang_pred", "_lang_score", "_lang_fit"]
    by_id = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == len(ROWS) and all(by_id[i].lang_pred == "und" and by_id[i].lang_score == 0 for i in (3, 4, 7))
    assert by_id[9].lang_pred in model.langs
    assert {r.lang_pred for r in langid.identify(edge, langid.train(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_langid_letters(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "½ ② ²"), (3, "Ⅷ"), (4, "١٢ 一2"), (5, "_-1"), (6, "ª")], "id bigint, text string")
    model = langid.train(docs.where("id = 1").withColumn("lang", F.lit("en")), id_col="id")
    assert {r.id: r.lang_pred for r in langid.identify(docs, model).collect()} == {1: "en", 2: "und", 3: "und", 4: "en", 5: "und", 6: "en"}


def brute_naive_bayes(train, texts):
    """(language, posterior, fit) with plain dicts over the n-grams' buckets."""
    grams = lambda t: [tuple(x) for x in langid.buckets(np.frombuffer((t.lower() + "\0\0").encode("utf-32-le"), np.uint32)).T.tolist()]
    counts, docs = defaultdict(Counter), Counter()
    for text, lang in train:
        docs[lang] += 1
        for pair in grams(text):
            counts[lang].update(pair)
    size = {(lang, row): sum(n for b, n in c.items() if b // langid.BUCKETS == row) + langid.ALPHA * langid.BUCKETS for lang, c in counts.items() for row in (0, 1)}
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append((langid.UNKNOWN, 0.0, 0.0))
            continue
        like = {lang: sum(math.log((counts[lang][b] + langid.ALPHA) / size[lang, b // langid.BUCKETS]) for pair in grams(text) for b in pair) for lang in docs}
        joint = {lang: like[lang] + math.log(docs[lang] / sum(docs.values())) for lang in docs}
        best = max(sorted(joint), key=joint.get)
        out.append((best, 1 / sum(math.exp(x - joint[best]) for x in joint.values()), like[best] / (2 * len(grams(text))) + math.log(langid.BUCKETS)))
    return out


def test_langid_against_plain_naive_bayes(spark):
    train = [("the cat sat on the mat", "en"), ("a dog and the cat", "en"), ("le chat est sur la table", "fr"), ("der Hund und die Katze", "de"), ("die Maus", "de")]
    texts = ["the dog", "le chien est la", "und die", "xyzzy", "", None, "12 3", "ß", "ΩΨ ΞΔΘ"]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.lang_score, r.lang_fit) for r in langid.identify(asked, langid.train(docs)).collect()}
    for i, (lang, score, fit) in enumerate(brute_naive_bayes(train, texts)):
        assert got[i][0] == lang and got[i][1:] == pytest.approx((score, fit), abs=1e-4)
    assert got[0][2] > 0 and got[8][2] < 0


def test_langid_slabs_agree(monkeypatch):
    rng = np.random.default_rng(0)
    logp = rng.standard_normal((2 * langid.BUCKETS, 3)).astype(np.float32)
    texts = [LONG[:9000], "short one", None, "é" * 500]
    want = langid.predict(["a", "b", "c"], np.zeros(3), logp, texts)
    monkeypatch.setattr(langid, "SLAB", 100)
    assert langid.predict(["a", "b", "c"], np.zeros(3), logp, texts)[0] == want[0]


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a.b/c?d", "same"), (1, "http://x.y", "same"), (2, None, ""), (4, "bad\r\nurl", None), (5, "http://u", "WARC/1.1\r\n\r\nno\r\n\r\n"), (5, "http://u", "WARC/1.1\r\n\r\nno\r\n\r\n"), (None, "http://n", "nobody"), (7, "http://é.fr/ü", "päge 😀")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, id string")
    path = str(tmp_path / "archive")
    warc.write(pages, path)
    got, captures = {}, warc.assemble(warc.read(spark, path)).collect()
    for r in sorted(captures, key=lambda r: r.response.type, reverse=True):  # a response stands for its page's revisits
        got[r.metadata.page] = r
        assert r.request.uri == r.response.uri
    assert len(captures) == len(rows) and len({r.capture_id for r in captures}) == len(rows)
    assert got["3"].response.type == "revisit" and got["3"].response.refers_to == got["1"].response.record_id
    assert got["4"].response.type == "revisit" and got["4"].response.refers_to == got["2"].response.record_id and got["2"].metadata.payload_bytes == 0
    assert bytes(got["5"].response.payload).decode() == rows[4][2]
    assert [r.response.refers_to for r in captures if r.metadata.page == "5" and r.response.type == "revisit"] == [got["5"].response.record_id]
    assert bytes(got["7"].response.payload).decode() == "päge 😀" and got[None].response.type == "response"
    small = warc.write(pages, str(tmp_path / "b"), revisit_from=100)
    assert small is None and {r.response.type for r in warc.assemble(warc.read(spark, str(tmp_path / "b"))).collect()} == {"response"}
    assert common.shared_dir(spark)


def brute_warc(pages):
    """(page, bytes, digest, type, page of the response) of each row."""
    import base64

    first, out = {}, []
    for page, html in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        kind = "revisit" if data in first else "response"
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first.get(data)))
        first.setdefault(data, page)
    return Counter(out)


def test_warc_query(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert Counter(map(tuple, warc.query(spark, SF).collect())) == brute_warc([(r.page_id, r.html) for r in pages.collect()])
    odd = [(3, "u", "a"), (1, None, "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", None), (None, None, ""), (9, "", None), (9, "u", "é" * 70_000), (9, "u", "b")]
    for name, rows in (("odd", odd), ("none", []), ("nulls", [(None, None, None)] * 3)):
        spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, size string").write.parquet(str(tmp_path / name / "pages.parquet"))
        assert Counter(map(tuple, warc.query(spark, str(tmp_path / name)).collect())) == brute_warc([(r[0], r[2]) for r in rows])


def test_warc_parses_a_stream(monkeypatch):
    import io

    record = lambda kind, block: b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    blocks = [b"", b"\r\n\r\nWARC/1.1", b"x" * 5000]
    data = b"".join(record(b"response", x) for x in blocks)
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        assert [x for _, x in warc.parse(io.BytesIO(data))] == blocks
    for bad in (data[:-3], data[:20], b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


# ---------------------------------------------------------------- toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = ["idiot$", "scum$", "moron$", "worthless$", "réeux", "achlich"]
    matcher = toxicity.Matcher(terms)
    words = ["idiot", "idot", "idioot", "xdiot", "diot", "scun", "réeuxabc", "réexabc", "achlichkeit", "aclichkeit", "worthles", "worth", ""] + ["".join(rng.choice("idotmrn") for _ in range(rng.randrange(1, 8))) for _ in range(800)]
    for w in words:
        want = {}
        for i, t in enumerate(terms):
            bare = t.removesuffix("$")
            e = edits(bare, w) if t.endswith("$") else min(edits(bare, w[:k]) for k in range(len(w) + 1))
            if e == 0 or e == 1 and len(bare) >= toxicity.FUZZY_LEN:
                want[i] = e
        assert matcher.hits(w) == want, w


def test_quotation_weighs_less():
    matcher = toxicity.Matcher(["idiot$"])
    plain, quoted = (toxicity.features(toxicity.found(matcher, t, {}), [4.0], [2.0]) for t in ("you are an idiot today", 'the word "idiot" is rude'))
    assert plain[0] == 4.0 and quoted[0] == 1.0
    assert toxicity.features(toxicity.found(matcher, "what an idoit, an idoot", {}), [4.0], [2.0])[0] == 2.0


def test_toxicity_held_out_and_edges(spark, edge, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.8 and hit / (got.predicted == 1).sum() > 0.9
    model = toxicity.train(edge, spark.createDataFrame([(1, 1), (5, 0), (None, 1), (3, None)], "doc_id bigint, toxic int"))
    rows = toxicity.score(edge, model)
    assert rows.count() == len(ROWS) and rows.where("toxic_score IS NULL OR toxic_score NOT BETWEEN 0 AND 1").count() == 0
    none = toxicity.train(edge, labels.limit(0))
    assert {r.toxic_score for r in toxicity.score(edge, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_ignores_held_out_labels(spark, tmp_path):
    sf, out = "/root/testdata/sf0.01", []
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = common.fold(F.col("doc_id"), 4) == 2
    for i, value in enumerate((None, 0, 1)):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "documents.parquet").symlink_to(f"{sf}/documents.parquet")
        flipped = labels if value is None else labels.withColumn("toxic", F.when(held, F.lit(value)).otherwise(F.col("toxic")).cast(labels.schema["toxic"].dataType))
        flipped.write.parquet(str(folder / "labels.parquet"))
        out.append(sorted((r.doc_id, r.score) for r in toxicity.query(spark, str(folder)).collect()))
    assert out[0] == out[1] == out[2]


def test_toxicity_keeps_a_column_of_its_name(spark, edge):
    clash = edge.withColumn("toxic_score", F.lit("own"))
    got = toxicity.score(clash, ([], [], [], np.zeros(0)))
    assert got.columns == [*clash.columns, "_toxic_score"] and {r.toxic_score for r in got.collect()} == {"own"}


# ---------------------------------------------------------------- Jaccard join


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    """Smallest id of each row's class by comparing every pair."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def test_jaccard_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    base = " ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(120)).split()
    for i in range(80):
        words = base[:]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in jaccard.classes(docs).collect()}
    assert got == dict(zip([d for d, _ in rows], brute_classes(rows)))
    kept = jaccard.dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_jaccard_blocks(spark, monkeypatch):
    """A bucket of many near copies is split, and its parts are found to be one class."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "DELEGATES", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 + 1 :]])) for i in range(150)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got} == {0} and all(r.n_links >= 1 and r.class_size == 150 for r in got)


def _edited(words, rng, n):
    words = words[:]
    for p in rng.sample(range(len(words)), n):
        words[p] = f"new{rng.randrange(10**9)}"
    return words


def test_jaccard_only_link_into_a_large_group(spark, monkeypatch):
    """Texts whose only link is to one member of a group that fills many blocks are linked to it."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "DELEGATES", 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    group = [_edited(base, rng, 2) for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, *group, *[_edited(w, rng, 4) for w in group[:20]]])]
    got = {r.doc_id: r.class_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == dict(zip([d for d, _ in rows], brute_classes(rows)))
    assert sum(c == 0 for c in got.values()) > 160


def test_jaccard_counts_every_link(spark, monkeypatch):
    """n_links is the number of different texts within the threshold, in a class of one block and of many."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(_edited(base, rng, 1 + i % 3))) for i in range(90)]
    rows += [(100 + i, text) for i, (_, text) in enumerate(rows[:10])] + [(200, "alone here"), (201, None)]
    sets = {t: shingles(t) for _, t in rows}
    want = {d: sum(t != u and bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9 for u, b in sets.items()) for d, t in rows for a in [sets[t]]}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (jaccard.BLOCK, 16):
        monkeypatch.setattr(jaccard, "BLOCK", size)
        assert {r.doc_id: r.n_links for r in jaccard.classes(docs).collect()} == want
    assert 40 < want[0] < 90


def test_jaccard_edges(spark, edge, empty):
    got = jaccard.classes(edge).collect()
    assert len(got) == len(ROWS)
    want = Counter(map(str, brute_classes([(r[0], r[1]) for r in ROWS])))
    assert Counter(str(r.class_id) for r in got) == want
    kept = jaccard.dedup(edge)
    assert kept.columns == edge.columns and kept.count() == len({r[1] or "" for r in ROWS})
    assert jaccard.classes(empty).count() == 0 and jaccard.dedup(empty).count() == 0


def test_shingle_hashes_by_slab(monkeypatch):
    texts = [b"a b c d e f g", b"", None, b"  ", b"x", LONG.encode(), b"a b c d e f g"]
    whole = {i: set(h.tolist()) for idx, hs, at in jaccard._documents(texts) for i, h in zip(idx, np.split(hs, at[1:]))}
    monkeypatch.setattr(jaccard, "SLAB", 1)
    single = {i: set(h.tolist()) for idx, hs, at in jaccard._documents(texts) for i, h in zip(idx, np.split(hs, at[1:]))}
    assert whole == single and whole[0] == whole[6] and set(whole) == {0, 4, 5, 6}
    assert len(whole[0]) == 3 and len(whole[5]) == len(shingles(LONG))


def test_forest_spans_with_the_heaviest_edges():
    rng = np.random.default_rng(3)
    for m in (3, 9, 30):
        weight = rng.integers(-3, 40, (m, m)).astype(float)
        weight = np.where(np.maximum(weight, weight.T) < 5, -1, np.maximum(weight, weight.T))
        comp = rng.integers(0, m, m)
        weight[comp[:, None] == comp] = np.inf
        got = list(jaccard._forest(weight))
        parent = list(range(m))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        want, edges = 0.0, sorted(((weight[x, y], x, y) for x in range(m) for y in range(x) if weight[x, y] >= 0), reverse=True)
        for w, x, y in edges:  # Kruskal's
            if find(x) != find(y):
                parent[find(x)] = find(y)
                want += w if w < np.inf else 0
        assert sum(weight[x, y] for x, y in got) == want and len(got) < m and all(weight[x, y] < np.inf for x, y in got)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


