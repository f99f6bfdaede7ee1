"""Repair and checks of bias records in JSON (F47, F49, F50), as Columns. Null and empty input give null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SHAPE = "dir struct<L: double, C: double, R: double>, deg struct<L: double, M: double, H: double>, reason string"


def repair_json(raw: Column) -> Column:
    """Valid JSON as it is; else keys are quoted, dir and deg get braces, trailing commas go, strings and braces are closed."""
    s = F.trim(raw)
    s = F.regexp_replace(s, r",\s*([}\]])", "$1")
    s = F.regexp_replace(s, r'(^|[{,])\s*([A-Za-z_]+)"\s*:', '$1"$2":')
    s = F.regexp_replace(s, r'"(dir|deg)"\s*:\s*"([A-Z])"\s*:', '"$1":{"$2":')
    s = F.regexp_replace(s, r'([0-9.]+)\s*,\s*"(deg|reason)"\s*:', '$1},"$2":')
    s = let(s, lambda x: F.when(F.startswith(x, F.lit("{")), x).otherwise(F.concat(F.lit("{"), x)))
    s = let(s, lambda x: F.when(F.regexp_count(x, F.lit('"')) % 2 == 1, F.concat(x, F.lit('"'))).otherwise(x))
    s = let(s, lambda x: F.concat(x, F.repeat(F.lit("}"), F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}")))))
    # the parser stops after a first value, so what doesn't begin with a brace isn't valid yet
    return F.when(F.trim(raw) == "", F.lit(None)).when(F.startswith(F.ltrim(raw), F.lit("{")) & F.try_parse_json(raw).isNotNull(), raw).otherwise(s)


def _whole(x: Column) -> Column:
    ok = F.lit(True)
    for field in [x["dir"][k] for k in "LCR"] + [x["deg"][k] for k in "LMH"] + [x["reason"]]:
        ok = ok & field.isNotNull()
    return ok


def canonical(raw: Column) -> Column:
    """dir (L, C, R), deg (L, M, H) and reason in this order, or null if any is missing."""
    return let(F.from_json(raw, SHAPE), lambda x: F.when(_whole(x), F.to_json(x)))


def lenient(raw: Column) -> Column:
    """dir and deg from the first six numbers that stand after a one-letter key, in order; null if there are fewer."""
    got = F.regexp_extract_all(raw, F.lit(r'"[LCRMH]"\s*:\s*([0-9.]+)'), F.lit(1))
    at = lambda i: F.get(got, i).cast("double")
    return F.when(F.size(got) >= 6, F.struct(*(at(i).alias(n) for i, n in enumerate(("dir_l", "dir_c", "dir_r", "deg_l", "deg_m", "deg_h")))))


#: Other names of keys and fields, in the order in which they are tried.
DIR_KEYS = {"L": ("left", "l", "LEFT", "Left"), "C": ("center", "c", "CENTER", "Center", "centre"), "R": ("right", "r", "RIGHT", "Right")}
DEG_KEYS = {"L": ("low", "l", "LOW", "Low"), "M": ("medium", "m", "MEDIUM", "Medium", "moderate"), "H": ("high", "h", "HIGH", "High", "heavy")}
DIR_FIELDS = ("direction", "bias_dir", "political_dir", "orientation")
DEG_FIELDS = ("degree", "bias_deg", "intensity", "strength")
REASON_FIELDS = ("explanation", "rationale", "analysis", "why", "justification")


def normalise_keys(raw: Column) -> Column:
    """dir, deg, reason in JSON with their usual names (F48), as normalised() has them."""
    return F.to_json(normalised(raw))


def normalised(raw: Column) -> Column:
    """dir, deg, reason under their usual names. Keys under another field name stay as they are; a field that is there
    under its own name wins. Null if raw isn't an object."""
    fields = (*("dir", *DIR_FIELDS), *("deg", *DEG_FIELDS))
    schema = ", ".join(f"{f} map<string, double>" for f in fields) + ", " + ", ".join(f"{f} string" for f in ("reason", *REASON_FIELDS))

    def axis(own: Column, keys: dict[str, tuple[str, ...]]) -> Column:
        last = lambda k: F.try_element_at(F.filter(F.map_entries(own), lambda e: e["key"].isin(k, *keys[k])), F.lit(-1))["value"]
        return F.when(own.isNotNull(), F.struct(*(last(k).alias(k) for k in keys)))

    def named(x: Column) -> Column:
        def other(names: tuple[str, ...], keys: dict[str, tuple[str, ...]]) -> list[Column]:
            return [F.when(x[n].isNotNull(), F.struct(*(F.try_element_at(x[n], F.lit(k)).alias(k) for k in keys))) for n in names]

        dirs = F.coalesce(axis(x["dir"], DIR_KEYS), *other(DIR_FIELDS, DIR_KEYS))
        degs = F.coalesce(axis(x["deg"], DEG_KEYS), *other(DEG_FIELDS, DEG_KEYS))
        reason = F.coalesce(x["reason"], *(x[n] for n in REASON_FIELDS))
        return F.struct(dirs.alias("dir"), degs.alias("deg"), reason.alias("reason"))

    # each text is parsed once, however many fields are looked at
    return let(raw, lambda r: F.when(F.try_parse_json(r).isNotNull() & F.startswith(F.ltrim(r), F.lit("{")), let(F.from_json(r, schema), named)))


def final_json(text: Column) -> Column:
    """The last balanced object or array (F51), found backwards from the last closing brace or bracket; braces in strings
    count too. Null if there is none."""
    return F.arrow_udf(lambda texts: pa.array([_last_balanced(t) for t in texts.to_pylist()], pa.string()), "string")(text)


def _last_balanced(text: str | None) -> str | None:
    end = -1 if text is None else max(text.rfind("}"), text.rfind("]"))
    if end < 0:
        return None
    close, start = text[end], "{" if text[end] == "}" else "["
    depth, at, opened, closed = 1, end, text.rfind(start, 0, end), text.rfind(close, 0, end)
    while opened >= 0:  # from one brace or bracket of its kind to the one before
        at = max(opened, closed)
        depth += -1 if at == opened else 1
        if not depth:
            return text[at : end + 1]
        if at == opened:
            opened = text.rfind(start, 0, at)
        else:
            closed = text.rfind(close, 0, at)
    return None


def first_object(text: Column) -> Column:
    """The first object with at most one level of objects in it (F53); null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0), F.lit(""))


def outer_array(text: Column) -> Column:
    """From the first [ to the last ] (F54); null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def _named(x: Column, axis: str, names: dict[str, str]) -> tuple[Column, Column]:
    """The name and the value of the largest; the first of equals."""
    values = [x[axis][k] for k in names]
    most = F.greatest(*values)
    name = F.lit("Unknown")
    for k in reversed(names):
        name = F.when(x[axis][k] == most, names[k]).otherwise(name)
    return name, most


DIRECTIONS = {"L": "Left", "C": "Center", "R": "Right"}
DEGREES = {"L": "Low", "M": "Medium", "H": "High"}


def confidence(x: Column) -> Column:
    """The mean over both axes of how far the largest is above the mean."""
    above = lambda axis, keys: F.greatest(*(x[axis][k] for k in keys)) - sum((x[axis][k] for k in keys[1:]), x[axis][keys[0]]) / 3
    return (above("dir", "LCR") + above("deg", "LMH")) / 2


def formatted(record: Column, style: str = "json") -> Column:
    """A record of canonical JSON as JSON of style json, compact or text (F56); null if it isn't one."""
    return let(F.from_json(record, SHAPE), lambda x: F.when(_whole(x), F.to_json(_styled(x, style))))


def results(raw: Column, style: str = "json") -> Column:
    """What formatted(normalise_keys(raw), style) has in its JSON, as fields: nothing is written as JSON and parsed again between."""
    return let(normalised(raw), lambda x: F.when(_whole(x), _styled(x, style)))


def _styled(x: Column, style: str) -> Column:
    (d, d_most), (g, g_most) = _named(x, "dir", DIRECTIONS), _named(x, "deg", DEGREES)
    reason = x["reason"]
    if style == "compact":
        out = F.struct(d.alias("direction"), g.alias("degree"), F.when(F.length(reason) > 100, F.concat(F.substring(reason, 1, 100), F.lit("..."))).otherwise(reason).alias("reason"))
    elif style == "text":
        percent = lambda v: F.concat(F.lit(" ("), F.round(v * 100, 1).cast("string"), F.lit("%)"))
        text = F.concat(F.lit("Political Bias Analysis\n========================\nDirection: "), d, percent(d_most), F.lit("\nDegree: "), g, percent(g_most), F.format_string("\nConfidence: %.1f%%\n\nReasoning:\n", confidence(x) * 100), reason)
        out = F.struct(text.alias("text"), d.alias("direction"), g.alias("degree"))
    else:
        out = F.struct(x["dir"].alias("dir"), x["deg"].alias("deg"), reason.alias("reason"), d.alias("dominant_direction"), g.alias("dominant_degree"), F.round(confidence(x), 3).alias("confidence"))
    return out
