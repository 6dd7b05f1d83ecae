"""Temporal expressions in text: extraction with positions, and normalisation against an anchor.

All of it is Spark's own expressions, written as SQL lambdas. A pattern's hits come from regexp_extract_all; their positions
are the lengths of what split leaves between them. Families are tried by priority and a hit that overlaps an accepted one
is dropped.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Number words, month names, weekdays, units with their length in microseconds.
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
MONTHS = {"january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DAY_US = 86_400_000_000
UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": DAY_US, "week": 7 * DAY_US, "month": 30 * DAY_US, "year": 365 * DAY_US}
DEFAULT_ANCHOR = datetime(2026, 9, 13)

_NUM = r"(?:\d+|" + "|".join(NUMBERS) + ")"
_UNIT = "(?:" + "|".join(f"{u}|{u}s" for u in UNITS) + ")"
_MONTH = "|".join(MONTHS)
#: The pattern of each family, in order of priority.
PATTERNS = {
    "iso": r"\b(\d{4})-(\d{2})-(\d{2})\b",
    "day_month": rf"(?i)\b(?:on\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\s+(\d{{4}})\b",
    "month_day": rf"(?i)\b(?:on\s+)?({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b",
    "time": r"(?i)\b(?:at\s+)?([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?\s*(am|pm)?\b",
    "offset": rf"(?i)\b({_NUM})\s+({_UNIT})\s+(ago|earlier|before|later|after)\b",
    "named": r"(?i)\b(today|yesterday|tomorrow)\b",
    "weekday": r"(?i)\b(last|next|this)\s+(" + "|".join(WEEKDAYS) + r")\b",
    "duration": rf"(?i)\b(?:for|lasted\s+(?:for\s+)?|lasting|duration\s+of)\s+({_NUM})\s+({_UNIT})\b",
}
#: Fields of an expression and their types.
FIELDS = {
    "start": "int", "stop": "int", "raw": "string", "type": "string", "year": "int", "month": "int", "day": "int", "hour": "int", "minute": "int", "second": "int",
    "value": "bigint", "unit": "string", "direction": "string", "named": "string", "modifier": "string", "weekday": "string", "offset_days": "int",
}
_KIND = "array<struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">>"


#: Type of each family's expressions.
TYPES = {"iso": "ABSOLUTE_DATE", "day_month": "ABSOLUTE_DATE", "month_day": "ABSOLUTE_DATE", "time": "TIME", "offset": "RELATIVE_DATE", "named": "RELATIVE_DATE", "weekday": "RELATIVE_DATE", "duration": "DURATION"}
#: First and last moment that a timestamp can hold with a year of four digits.
_FIRST_US, _LAST_US = (int((datetime(*d) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for d in ((1, 1, 1), (9999, 12, 31)))


# ------------------------------------------------------------------ SQL text


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v}L" for k, v in values.items()) + ")"


def _struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', CAST({values.get(k, 'NULL')} AS {t})" for k, t in FIELDS.items()) + ")"


def _family_sql(name: str, t: str) -> str:
    """Expressions of one family in the string t, as SQL.

    A text without a hit is passed once, one with hits three times; groups are read off the hits alone, which the
    patterns, bounded by word edges, match in the same way as the text.
    """
    p = f"r'{PATTERNS[name]}'"
    group = lambda k: f"regexp_extract(x.hit, {p}, {k})"
    low = lambda k: f"lower({group(k)})"
    whole = lambda k: f"try_cast(nullif({group(k)}, '') AS INT)"
    # digits or a word; null if it doesn't fit a long
    amount = {"value": f"coalesce({_map(NUMBERS)}[{low(1)}], try_cast({group(1)} AS BIGINT))", "unit": f"trim(TRAILING 's' FROM {low(2)})"}
    month = lambda k: f"{_map(MONTHS)}[{low(k)}]"
    day = low(1)
    fields = {
        "iso": lambda: {"year": whole(1), "month": whole(2), "day": whole(3)},
        "day_month": lambda: {"day": whole(1), "month": month(2), "year": whole(3)},
        "month_day": lambda: {"month": month(1), "day": whole(2), "year": whole(3)},
        "time": lambda: {"hour": f"CASE WHEN {low(4)} = 'pm' AND {whole(1)} < 12 THEN {whole(1)} + 12 WHEN {low(4)} = 'am' AND {whole(1)} = 12 THEN 0 ELSE {whole(1)} END", "minute": whole(2), "second": f"coalesce({whole(3)}, 0)"},
        "offset": lambda: amount | {"direction": f"CASE WHEN {low(3)} IN ('ago', 'earlier', 'before') THEN 'past' ELSE 'future' END"},
        "named": lambda: {
            "named": day, "offset_days": f"CASE {day} WHEN 'yesterday' THEN -1 WHEN 'tomorrow' THEN 1 ELSE 0 END", "value": f"CASE {day} WHEN 'today' THEN 0 ELSE 1 END",
            "unit": "'day'", "direction": f"CASE {day} WHEN 'yesterday' THEN 'past' WHEN 'tomorrow' THEN 'future' ELSE 'current' END",
        },
        "weekday": lambda: {"modifier": low(1), "weekday": low(2)},
        "duration": lambda: amount,
    }[name]()
    one = _struct({"start": "acc.at + length(x.gap)", "stop": "acc.at + length(x.gap) + length(x.hit)", "raw": "x.hit", "type": f"'{TYPES[name]}'"} | fields)
    hits = f"zip_with(slice(split({t}, {p}, -1), 1, size(h)), h, (gap, hit) -> named_struct('gap', gap, 'hit', hit))"
    placed = f"aggregate({hits}, named_struct('at', 0, 'out', CAST(array() AS {_KIND})), (acc, x) -> named_struct('at', acc.at + length(x.gap) + length(x.hit), 'out', concat(acc.out, array({one}))), acc -> acc.out)"
    return f"CASE WHEN regexp_like({t}, {p}) THEN transform(array(regexp_extract_all({t}, {p}, 0)), h -> {placed})[0] WHEN {t} IS NOT NULL THEN CAST(array() AS {_KIND}) END"


def _extract_sql(t: str) -> str:
    """The families' hits by priority, without those that overlap an accepted one, by position."""
    every = "concat(" + ", ".join(_family_sql(name, t) for name in PATTERNS) + ")"
    return f"array_sort(aggregate({every}, CAST(array() AS {_KIND}), (kept, x) -> CASE WHEN exists(kept, y -> greatest(x.start, y.start) < least(x.stop, y.stop)) THEN kept ELSE concat(kept, array(x)) END))"


def _ts_sql(us: str) -> str:
    """Null beyond the years 1 to 9999."""
    return f"CASE WHEN {us} BETWEEN {_FIRST_US} AND {_LAST_US} THEN CAST(timestamp_micros({us}) AS TIMESTAMP_NTZ) END"


def _us_sql(e: str, ref: str) -> str:
    """Signed length of an expression in microseconds; null for dates and times."""
    size = f"try_multiply({e}.value, coalesce({_map(UNITS)}[{e}.unit], {UNITS['second']}L))"
    today = f"pmod(floor({ref} / {DAY_US}) + 3, 7)"  # Monday is 0
    target = "(array_position(array(" + ", ".join(f"'{d}'" for d in WEEKDAYS) + f"), {e}.weekday) - 1)"
    ahead, back = f"coalesce(nullif(pmod({target} - {today}, 7), 0), 7)", f"coalesce(nullif(pmod({today} - {target}, 7), 0), 7)"
    days = f"CASE {e}.modifier WHEN 'next' THEN {ahead} WHEN 'last' THEN -{back} ELSE {target} - {today} END"
    return (
        f"CASE WHEN {e}.type = 'DURATION' THEN {size} WHEN {e}.named IS NOT NULL THEN {e}.offset_days * {DAY_US}L WHEN {e}.weekday IS NOT NULL THEN CAST({days} AS BIGINT) * {DAY_US}L "
        f"WHEN {e}.type = 'RELATIVE_DATE' THEN CASE WHEN {e}.direction = 'past' THEN -{size} ELSE {size} END END"
    )


def _when_sql(e: str, ref: str) -> str:
    """Moment of an expression; null for durations and impossible dates. A date without a year takes the anchor's."""
    date = f"try_make_timestamp_ntz(coalesce({e}.year, year({_ts_sql(ref)})), {e}.month, {e}.day, 0, 0, 0)"
    clock = f"(CAST(floor({ref} / {DAY_US}) AS BIGINT) * {DAY_US}L + ({e}.hour * 3600L + {e}.minute * 60 + {e}.second) * 1000000L)"
    return f"CASE {e}.type WHEN 'ABSOLUTE_DATE' THEN {date} WHEN 'TIME' THEN {_ts_sql(clock)} WHEN 'RELATIVE_DATE' THEN {_ts_sql(f'try_add({ref}, {_us_sql(e, ref)})')} END"


def _apply(sql: str, value: Column) -> Column:
    """A SQL lambda applied to a column. It is parsed as a whole, where thousands of calls would build the same tree."""
    return F.call_function("transform", F.array(value), F.expr(sql))[0]


# ------------------------------------------------------------------ columns


def family(text: Column, name: str) -> Column:
    """All hits of one family as expressions, without regard to the others."""
    return _apply(f"v -> {_family_sql(name, 'v')}", text)


def extract(text: Column) -> Column:
    """The expressions of a text by position; of overlapping hits the family of higher priority wins, then the earlier."""
    return _apply(f"v -> {_extract_sql('v')}", text)


def anchor_us(anchor: datetime | Column | None) -> Column:
    if isinstance(anchor, Column):
        return F.unix_micros(anchor.cast("timestamp"))
    a = anchor or DEFAULT_ANCHOR
    return F.lit(int((a - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)


def normalize(expressions: Column, anchor: datetime | Column | None = None) -> Column:
    """The expressions with resolved_ts and resolved_us."""
    fields = ", ".join(f"'{k}', e.{k}" for k in FIELDS)
    one = f"named_struct({fields}, 'resolved_ts', {_when_sql('e', 'v.ref')}, 'resolved_us', {_us_sql('e', 'v.ref')})"
    return _apply(f"v -> transform(v.x, e -> {one})", F.struct(expressions.alias("x"), anchor_us(anchor).cast("long").alias("ref")))


def first_resolved(text: Column, field: str, anchor: datetime | Column | None = None) -> Column:
    """The first moment (field ts) or length in microseconds (us) that an expression of the text has."""
    found = (_us_sql if field == "us" else _when_sql)("e", "v.ref")
    return _apply(f"v -> get(filter(transform({_extract_sql('v.t')}, e -> {found}), r -> r IS NOT NULL), 0)", F.struct(text.alias("t"), anchor_us(anchor).cast("long").alias("ref")))


def parse_duration_us(text: Column) -> Column:
    """Microseconds of '90m', '2 hours', '1.5 d', '30 sec' or plain seconds; null for anything else or too long."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^(-?[0-9]+(?:\.[0-9]+)?)\s*(m|min|minutes|h|hr|hours|d|days|s|sec|seconds)?$", 1)
    unit = F.regexp_extract(low, r"^(-?[0-9]+(?:\.[0-9]+)?)\s*(m|min|minutes|h|hr|hours|d|days|s|sec|seconds)?$", 2)
    size = F.when(unit.startswith("m"), UNITS["minute"]).when(unit.startswith("h"), UNITS["hour"]).when(unit.startswith("d"), UNITS["day"]).otherwise(UNITS["second"])
    return F.when(number != "", F.round(number.try_cast("double") * size).try_cast("long"))


def parse_iso(text: Column) -> Column:
    """TIMESTAMP_NTZ of an ISO date or date-time; null if it isn't one."""
    return text.try_cast("timestamp_ntz")


class ExtractTemporal:
    """Table function: the expressions of a text, one row each; for SQL, where extract() is for columns."""

    def __init__(self):
        self.patterns = [(TYPES[name], re.compile(pattern, re.ASCII)) for name, pattern in PATTERNS.items()]

    def eval(self, text: str):
        kept: list[tuple[int, int, str, str]] = []
        for type_, pattern in self.patterns:
            for m in pattern.finditer(text or ""):
                if all(m.end() <= start or stop <= m.start() for start, stop, _, _ in kept):
                    kept.append((m.start(), m.end(), m.group(), type_))
        yield from sorted(kept)


def register(spark: SparkSession) -> None:
    """SQL table function extract_temporal(text): start, stop, raw, type."""
    spark.udtf.register("extract_temporal", F.udtf(ExtractTemporal, returnType="start int, stop int, raw string, type string"))
