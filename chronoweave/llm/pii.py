"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. High-recall generators propose
more spans, which may overlap: emails with written-out signs, IPv6 addresses, cards of 13 to 19 digits, phone numbers
without a plus. What a candidate teaches is evidence that neither its generator nor its features see: a card's checksum, a known
top-level domain, the form of an IPv6 address, the first digits of a dialling code. Its features are format and context
alone (separators, grouping, digits, the words and the sign before it), so that the trees say how likely evidence is for a
span of that look and place, also where none can be checked.

Counts of candidates and evidence by bits of features and fold (at most KINDS * FOLDS * 2^FEATURES rows) train boosted trees
of depth 2 on the driver. Each fold of the texts is scored by trees that never saw it; on these scores an isotonic
regression calibrates each kind, and its threshold is the lowest score whose calibrated probability reaches PRECISION.
Trees over all folds then score candidates as column expressions. Candidates at the threshold or above that touch no base
span are added; of overlapping ones the kind listed first stays, and of one kind the one that starts first.

Positions are code points. Patterns are the stated ones, rewritten so that each text is passed once: runs start behind
a look-behind and repeat possessively, which finds the same leftmost non-overlapping matches without retries.

Defined cases: a null text is empty and has no spans. Rows are handled one by one, so repeated rows, null ids and extra
columns do no harm. With no candidates at all nothing is trained and nothing added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 40
RATE = 0.3
#: Least calibrated probability of evidence for a candidate to be added.
PRECISION = 0.9
#: Parts that the texts are dealt into for scores by trees that never saw them.
FOLDS = 5
#: Characters of context before a candidate.
CONTEXT = 32

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns; a card's pattern holds its number of digits, since other maximal runs fail anyway.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = (rf"(?:{sign}| ?[\[(<{{] ?{word} ?[\])>}}] ?)" for sign, word in (("@", "at"), (r"\.", "dot")))
#: (kind, what a text must hold, pattern) of each generator.
GENERATORS = (
    ("email", r"[@\[(<{] ?(?:at ?[\])>}])?", rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    ("email", r" dot ", rf"(?<!{_LOCAL}){_LOCAL}++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])"),
    ("ip", r":[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"),
    ("card", r"[0-9]", r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}+(?![0-9])"),
    ("phone", r"[0-9][) .-]", r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"),
)
#: Words before a span that name its kind, words that name something else, common top-level domains.
CUES = {
    "email": "mail|contact|write|reach|address",
    "ip": "ip|host|server|addr|address|client|from",
    "card": "card|visa|mastercard|amex|cc|payment|pan|account",
    "phone": "tel|phone|call|fax|mobile|cell|telephone|whatsapp|sms|contact",
}
OTHER_CUES = "order|id|isbn|serial|no|number|version|ver|date|item|sku|invoice|ticket|build|time|at"
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|uk|us|de|fr|es|it|nl|ch|at|be|se|no|dk|fi|pl|pt|ru|cn|jp|kr|in|au|ca|br|mx|example|test"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum: every second digit from the right counts twice, less 9 if over 9."""
    turned = F.reverse(number)

    def add(total, i):
        d = F.coalesce(F.substring(turned, i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    number = digits(value)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))
    if kind == "card":
        return F.length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.lit(True)


def _placed(text: Column, hits: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of the hits of a pattern, from what stands between them."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["between"])
        stop = (start + F.length(x["hit"])).cast("int")
        one = F.struct(start.cast("int").alias("start"), stop.alias("stop"), x["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.arrays_zip(between.alias("between"), hits.alias("hit"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])).otherwise(none)


def _like(value: Column, pattern: str) -> Column:
    return F.regexp_like(value, F.lit(pattern))


def _cue(words: str) -> str:
    return rf"(?i)(?<![A-Za-z])(?:{words})s?(?: (?:me|us|is|was|number|no|on|at|to))?[.:=#]* *[\"'(<]?$"


#: Format and context of a candidate, as bits; v is the value, b the text before it, k its kind.
FEATURES = (
    lambda v, b, k: _like(v, r"[ .-]"),
    lambda v, b, k: _like(v, r"[()\[\]<>{}]"),
    lambda v, b, k: _like(v, r"^[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"),
    lambda v, b, k: _like(v, r"^[0-9]{4}([ .-])[0-9]{6}\1[0-9]{4,5}$"),
    lambda v, b, k: _like(v, r"^\(?[0-9]{3}(?:\) ?|([ .-]))[0-9]{3}[ .-][0-9]{4}$"),
    lambda v, b, k: F.length(digits(v)).between(10, 11),
    lambda v, b, k: F.length(digits(v)) >= 16,
    lambda v, b, k: _like(b, _cue(CUES[k])),
    lambda v, b, k: _like(b, _cue(OTHER_CUES)),
    lambda v, b, k: _like(b, r"[=/#_A-Za-z0-9.,:-]$"),
    lambda v, b, k: _like(v, r"^[3-6]") if k == "card" else _like(v, r"[A-Za-z]"),
    lambda v, b, k: _like(v, r" (?:at|dot) | ?[\[(<{] ?(?:at|dot)") if k == "email" else _like(v, r"[0-9A-Fa-f]{3}"),
)


def evidence(kind: str, value: Column) -> Column:
    """What speaks for a candidate beyond its look: nothing that a feature holds."""
    number = digits(value)
    if kind == "email":
        return _like(value, rf"(?i)(?:\.|dot ?[\])>}}]? ?)(?:{DOMAINS})$") & ~_like(value, r"^[.-]|\.\.|[.-](?:@| ?[\[(<{{])")
    if kind == "ip":
        groups = F.filter(F.split(value, ":"), lambda g: g != "")
        six = F.contains(value, F.lit(":")) & F.when(F.contains(value, F.lit("::")), ~_like(value, r"::.*::|:::") & (F.size(groups) >= 2)).otherwise(F.size(groups) == 8)
        return six | (~F.contains(value, F.lit(":")) & _valid("ip", value))
    if kind == "card":
        return luhn(number) & ~_like(number, r"^0|^(.)\1*$")
    national = _like(number, r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$")
    return F.length(number).between(8, 15) & (national | _like(number, r"^00[1-9]"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def candidates(docs: DataFrame, text_col="text") -> DataFrame:
    """docs without its text, with base: array<struct<kind, start, stop>>, cand: the same and bits, positive, and fold.

    Columns of docs that have those names, or spans, are dropped.
    """
    docs, base, cand = docs.drop("base", "cand", "spans", "fold"), "base", "cand"
    text = common.free_name(docs.columns, "_text")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    t = F.col(text)
    asked = {kind: F.contains(t, F.lit("@")) if kind == "email" else _like(t, "[0-9]") for kind in KINDS}
    names = {i: common.free_name(docs.columns, f"_base_{i}") for i in range(len(KINDS))}
    more = {i: common.free_name(docs.columns, f"_more_{i}") for i in range(len(GENERATORS))}
    patterns = {names[i]: (asked[kind], BASE[kind]) for i, kind in enumerate(KINDS)} | {more[i]: (_like(t, need), p) for i, (_, need, p) in enumerate(GENERATORS)}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({name: F.when(need, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none) for name, (need, pattern) in patterns.items()})
    rows = rows.withColumns({name: _placed(t, F.col(name), pattern) for name, (_, pattern) in patterns.items()})

    def checked(i, kind):
        good = F.filter(F.col(names[i]), lambda s: _valid(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    rows = rows.withColumn(base, F.concat(*[checked(i, kind) for i, kind in enumerate(KINDS)]))

    def described(kind):
        def one(s):
            low = F.greatest(s["start"] - CONTEXT, F.lit(0))
            before = F.substring(t, low + 1, s["start"] - low)
            bits = sum((F.when(f(s["value"], before, kind), 1 << k).otherwise(0) for k, f in enumerate(FEATURES)), F.lit(0))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), bits.cast("int").alias("bits"), F.coalesce(evidence(kind, s["value"]), F.lit(False)).alias("positive"))

        return one

    rows = rows.withColumn(cand, F.concat(*[F.transform(F.col(more[i]), described(kind)) for i, (kind, _, _) in enumerate(GENERATORS)]))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(t), F.lit(FOLDS)).cast("int"))
    return rows.select(*[c for c in docs.columns if c != text_col], base, cand, "fold")


def boost(cells: list[tuple[int, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Boosted depth-2 trees on (bits, n, positives): first log odds and trees (bit, (bit, no, yes), (bit, no, yes))."""
    n, y = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((y + 0.5) / (n - y + 0.5))
    score, trees = [start] * len(cells), []
    used = sorted({k for bits, _, _ in cells for k in range(bits.bit_length())})
    for _ in range(rounds if used else 0):
        grad, hess = [], []
        for (_, n, y), s in zip(cells, score):
            p = 1 / (1 + math.exp(-s))
            grad.append(y - n * p), hess.append(n * p * (1 - p))
        leaf = lambda some: rate * sum(grad[i] for i in some) / (sum(hess[i] for i in some) + 1)
        gain = lambda some: sum(grad[i] for i in some) ** 2 / (sum(hess[i] for i in some) + 1)

        def split(some):
            sides = {k: ([i for i in some if not cells[i][0] >> k & 1], [i for i in some if cells[i][0] >> k & 1]) for k in used}
            best = max(used, key=lambda k: gain(sides[k][0]) + gain(sides[k][1]))
            return best, *sides[best]

        bit, no, yes = split(range(len(cells)))
        tree = [bit]
        for some in (no, yes):
            b, left, right = split(some)
            tree.append((b, leaf(left), leaf(right)))
            for side in (left, right):
                for i in side:
                    score[i] += leaf(side)
        trees.append(tuple(tree))
    return start, trees


def _scored(bits: Column, model) -> Column:
    start, trees = model
    is_set = lambda k: bits.bitwiseAND(1 << k) != 0
    total = F.lit(start)
    for bit, *sides in trees:
        no, yes = (F.when(is_set(b), F.lit(right)).otherwise(F.lit(left)) for b, left, right in sides)
        total = total + F.when(is_set(bit), yes).otherwise(no)
    return total


def _score(bits: int, model) -> float:
    start, trees = model
    for bit, no, yes in trees:
        b, left, right = yes if bits >> bit & 1 else no
        start += right if bits >> b & 1 else left
    return start


def isotonic(points: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """(least score, probability) of the blocks of an isotonic regression of (score, n, positives), ascending."""
    blocks: list[list] = []
    for score, n, y in sorted(points):
        blocks.append([score, n, y])
        while len(blocks) > 1 and (blocks[-2][0] == blocks[-1][0] or blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]):
            _, n, y = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += y
    return [(score, (y + 0.5) / (n + 1)) for score, n, y in blocks]


def thresholds(cells: list[tuple[int, int, int, int]], precision: float = PRECISION) -> list[float]:
    """For each kind the lowest score whose calibrated probability reaches the precision; infinity if there is none.

    cells: bits with the kind above the features, fold, n, positives. A fold's scores are from trees without it.
    """
    points = [[] for _ in KINDS]
    for fold in sorted({c[1] for c in cells}):
        rest: dict[int, list] = {}
        for bits, of, n, y in cells:
            if of != fold:
                rest.setdefault(bits, [0, 0])
                rest[bits] = [rest[bits][0] + n, rest[bits][1] + y]
        if rest:
            model = boost([(bits, n, y) for bits, (n, y) in sorted(rest.items())])
            for bits, of, n, y in cells:
                if of == fold:
                    points[(bits >> len(FEATURES)).bit_length() - 1].append((_score(bits, model), n, y))
    return [min((score for score, p in isotonic(own) if p >= precision), default=float("inf")) for own in points]


def detect(docs: DataFrame, text_col="text", precision: float = PRECISION) -> DataFrame:
    """docs without its text, with base and spans (base and added): array<struct<kind, start, stop>> by kind and start."""
    rows = common.stage(candidates(docs, text_col), "candidates")
    with_kind = lambda c: c["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1 << len(FEATURES)), c["kind"]))
    each = rows.select("fold", F.explode("cand").alias("c"))
    cells = each.groupBy(with_kind(F.col("c")).alias("bits"), "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.positive").alias("y")).collect()
    cells = sorted((r.bits, r.fold, r.n, r.y) for r in cells)
    if not cells:
        return rows.select(*[c for c in rows.columns if c not in ("cand", "fold")], F.col("base").alias("spans"))
    whole: dict[int, tuple] = {}
    for bits, _, n, y in cells:
        whole[bits] = (whole.get(bits, (0, 0))[0] + n, whole.get(bits, (0, 0))[1] + y)
    model = boost([(bits, n, y) for bits, (n, y) in sorted(whole.items())])
    least = F.array(*[F.lit(x) for x in thresholds(cells, precision)])
    good = F.filter("cand", lambda c: (_scored(with_kind(c), model) >= F.element_at(least, c["kind"] + 1)) & ~F.exists("base", lambda b: _overlaps(b, c)))
    chosen = common.free_name(rows.columns, "_good")
    rows = rows.withColumn(chosen, F.when(F.size("cand") > 0, good).otherwise(F.array().cast(rows.schema["cand"].dataType)))
    first = lambda o, c: (o["kind"] < c["kind"]) | (o["kind"] == c["kind"]) & ((o["start"] < c["start"]) | (o["start"] == c["start"]) & (o["stop"] > c["stop"]))
    alone = F.filter(chosen, lambda c: ~F.exists(chosen, lambda o: first(o, c) & _overlaps(o, c)))
    added = F.array_distinct(F.transform(alone, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))))
    return rows.select(*[c for c in rows.columns if c not in ("cand", "fold", chosen)], F.array_sort(F.concat("base", added)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detect(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
