"""Text functions as Columns; strip means all whitespace, as articles have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), the value being computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def is_single_word(line: Column) -> Column:
    s = strip(line)
    return (s != "") & ~s.rlike(r"\s")


def clean_article(text: Column) -> Column:
    """Without single-word lines, runs of newlines as one, stripped."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~is_single_word(x))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n\n+", "\n"))


def normalise_line(line: Column) -> Column:
    """Lower-cased ASCII letters and digits; blanks at the ends go with all other signs."""
    return F.regexp_replace(F.lower(line), "[^a-z0-9]+", "")


def file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?* ,]', "_"), "_+", "_"), "^_|_$", "")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def pieces(c: Column, n: int) -> Column:
    """The text in pieces of n characters."""
    count = F.greatest(F.ceil(F.length(c) / n), F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.substr(c, (i * n + 1).cast("int"), F.lit(n)))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: x != "")


def title_case(c: Column) -> Column:
    """Every letter after a non-letter upper, all others lower (initcap only looks at blanks)."""
    parts = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def human_bytes(c: Column) -> Column:
    out = F.concat(F.round(c / 1024**3, 1).cast("string"), F.lit(" GB"))
    for unit, size in (("MB", 1024**3), ("KB", 1024**2)):
        out = F.when(c < size, F.concat(F.round(c / (size / 1024), 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).otherwise(out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rolling_hash(c: Column) -> Column:
    """31 h + code, in 32 bits, as hex (F27); negative ones with their sign, as hex of a signed number has it."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: F.pmod(s * 31 + x, F.lit(1 << 32)))
    return F.when(h >= 1 << 31, F.concat(F.lit("-"), F.lower(F.hex(F.lit(1 << 32) - h)))).otherwise(F.lower(F.hex(h)))
