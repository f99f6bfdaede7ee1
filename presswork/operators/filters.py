"""Predicates over articles, as Columns: they compose, and what can be pushed to the scan is."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "array<struct<text:string,label:string>>"


def blank(c: Column | str) -> Column:
    """Null or empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def valid_article(article: str = "article", error: str = "fetch_error") -> Column:
    return F.col(article).isNotNull() & blank(error)


def date_range(column: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> Column:
    """Inclusive on both ends; rows without a date are out if there is any bound."""
    out = F.lit(True)
    if start is not None:
        out &= F.col(column) >= F.lit(start)
    if end is not None:
        out &= F.col(column) <= F.lit(end)
    return F.coalesce(out, F.lit(False))


def any_date_range(columns: list[str], start: dt.datetime, end: dt.date) -> Column:
    """The range holds for any of the columns; the end day counts to its last second."""
    last = dt.datetime.combine(end, dt.time(23, 59, 59))
    return reduce(lambda a, b: a | b, (date_range(c, start, last) for c in columns))


def parse_date_arg(text: str, now: dt.datetime) -> dt.datetime:
    """-N: N days before now; else ISO-8601."""
    return now - dt.timedelta(days=int(text[1:])) if re.fullmatch(r"-\d+", text) else dt.datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)


def parse_entities(text: str | None) -> list[tuple[str | None, str | None]]:
    """Comma list of [LABEL/]TEXT, trimmed; split at the first slash."""
    out = []
    for part in (x.strip() for x in (text or "").split(",")):
        if part:
            label, slash, name = part.partition("/")
            out.append((label or None, name or None) if slash else (None, part))
    return out


def entity_match(entities: str, spec: tuple[str | None, str | None]) -> Column:
    """Label and text hold for one and the same element."""
    label, text = spec

    def one(e: Column) -> Column:
        out = F.lit(True)
        if label:
            out &= e["label"] == label
        if text:
            out &= e["text"] == text
        return out

    return F.exists(entities, one)


def entity_filter(entities: str, all_of: list = (), any_of: list = ()) -> Column:
    """Every one of all_of and at least one of any_of."""
    out = reduce(lambda a, b: a & b, (entity_match(entities, s) for s in all_of), F.lit(True))
    return out & reduce(lambda a, b: a | b, (entity_match(entities, s) for s in any_of), F.lit(not any_of))


def names_match(json_column: str, names: list[str], substring: bool = False, every: bool = False) -> Column:
    """Names in a JSON array of strings; bad JSON counts as empty."""
    have = F.coalesce(F.from_json(json_column, "array<string>"), F.array().cast("array<string>"))

    def one(name: str) -> Column:
        return F.exists(have, lambda x: F.contains(x, F.lit(name))) if substring else F.array_contains(have, name)

    tests = [one(n) for n in names]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def entity_regex(entities: str, pattern: str) -> Column:
    return F.exists(entities, lambda e: e["text"].rlike(f"(?i){pattern}"))


def has_terms(column: str, all_of: list[str] = (), any_of: list[str] = ()) -> Column:
    """Lower-cased text contains all of the one and any of the other; null text is out."""
    low = F.lower(column)
    out = reduce(lambda a, b: a & b, (F.contains(low, F.lit(t.lower())) for t in all_of), F.lit(True))
    out &= reduce(lambda a, b: a | b, (F.contains(low, F.lit(t.lower())) for t in any_of), F.lit(not any_of))
    return F.coalesce(out, F.lit(False))


def empty_fields(all_of: list[str] = (), any_of: list[str] = ()) -> Column:
    out = reduce(lambda a, b: a & b, (blank(c) for c in all_of), F.lit(True))
    return out & reduce(lambda a, b: a | b, (blank(c) for c in any_of), F.lit(not any_of))


def compile_filter(doc: dict) -> Column:
    """A nested filter document to a Column: $and $or $exists $ne $in $gte $lte $gt $lt $regex; anything else is an error.

    {field: None} holds for null, $ne for null too, as in document stores.
    """
    out = F.lit(True)
    for key, value in doc.items():
        if key in ("$and", "$or"):
            parts = [compile_filter(d) for d in value]
            out &= reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts)
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            out &= _field(F.col(key), value)
    return F.coalesce(out, F.lit(False))


def _field(c: Column, value) -> Column:
    if not isinstance(value, dict):
        return c.isNull() if value is None else c == F.lit(value)
    out = F.lit(True)
    for op, x in value.items():
        if op == "$exists":
            part = c.isNotNull() if x else c.isNull()
        elif op == "$ne":
            part = c.isNotNull() if x is None else ~c.eqNullSafe(F.lit(x))
        elif op == "$in":
            part = c.isin(list(x))
        elif op == "$regex":
            part = c.rlike(("(?i)" if value.get("$options") == "i" else "") + x)
        elif op == "$options":
            continue
        elif op in ("$gte", "$lte", "$gt", "$lt"):
            part = {"$gte": c.__ge__, "$lte": c.__le__, "$gt": c.__gt__, "$lt": c.__lt__}[op](F.lit(x))
        else:
            raise ValueError(f"unknown operator {op}")
        out &= F.coalesce(part, F.lit(False))
    return out
