"""Secret scans with an incremental blob ledger.

Every historical version of a file (here: a row with a path and a text) is addressed by the SHA-256 of its text. The
ledger tells for each blob the rules, by their versions, under which it was scanned, and the spans found; clean blobs are
in it, too. A scan looks only at pairs of a blob and a rule version that the ledger lacks, each once, however many paths
hold the blob; a changed or new rule is scanned alone. Findings are then joined back to all paths.

A cheap gate (fixed strings and short patterns of which every finding has one) runs in the JVM before anything moves:
a blob without any is clean, and only its address travels. Null texts are scanned as empty; equal rows share one
scan; spans that start together are listed in the order of RULES; very long texts are scanned whole, in linear time; other
columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds and patterns, in the order in which ties are listed. min: characters of the group.
BASE_RULES = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
EXTRA_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("userinfo", r"(?<![A-Za-z0-9_+.-])[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]{6,}@", 0, 1),
)
RULES = BASE_RULES + EXTRA_RULES
#: A rule's version is an address of the rule, so a changed rule is scanned anew by itself.
VERSIONS = {rule[0]: f"{rule[0]}@{hashlib.sha256(repr(rule).encode()).hexdigest()[:16]}" for rule in RULES}
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_COMPILED = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in RULES]


def find_secrets(text: str, kinds: frozenset[str] = frozenset(VERSIONS)) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of RULES; each kind leftmost, without overlap."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(_COMPILED):
        if kind not in kinds:
            continue
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def gate(text):
    """False only for texts in which no rule can match."""
    low = F.lower(text)
    hinted = F.lit(False)
    for hint in _HINTS:
        hinted = hinted | F.contains(low, F.lit(hint))
    for part in ("AKIA", "-----BEGIN", "xox", "eyJ", "://", "gh"):
        hinted = hinted | (F.contains(text, F.lit(part)) if part != "gh" else text.rlike("gh[pousr]_"))
    return hinted | text.rlike("[0-9a-f]{32}")


SPAN = "array<struct<kind: string, start: int, end: int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """blob, rules, text: the spans of the rules of each blob."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        kinds = [frozenset(x.partition("@")[0] for x in rules) for rules in batch.column(1).to_pylist()]
        spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find_secrets(t or "", k)] for t, k in zip(batch.column(2).to_pylist(), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(kind))], ["blob", "rules", "spans"])


def in_order(spans):
    """By start, then in the order of RULES."""
    order = F.create_map(*(x for i, kind in enumerate(VERSIONS) for x in (F.lit(kind), F.lit(i))))
    ranked = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.try_element_at(order, x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.transform(F.array_sort(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings by row of versions: path, blob, spans; the entries to append to the ledger: blob, rules, spans).

    ledger: entries of earlier scans. What it has under a rule's present version isn't scanned again; what it has under
    versions that are no longer in use doesn't count.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2(F.col("text"), 256))
    paths = rows.select("path", "blob")
    every = F.array(*map(F.lit, VERSIONS.values()))
    gated = rows.withColumn("gated", gate(F.col("text")))
    none = F.array().cast(SPAN)
    if ledger is None:
        once = gated.filter("gated").groupBy("blob").agg(F.first("text").alias("text")).select("blob", every.alias("rules"), "text")
        scanned = once.mapInArrow(_scan, f"blob string, rules array<string>, spans {SPAN}")
        clean = gated.filter("not gated").select("blob").distinct().select("blob", every.alias("rules"), none.alias("spans"))
        known = scanned.select("blob", "spans")
    else:
        version = F.create_map(*(F.lit(y) for pair in VERSIONS.items() for y in pair))
        current = F.filter("spans", lambda x: F.array_contains(F.col("rules"), F.try_element_at(version, x["kind"])))
        seen = ledger.select("blob", F.array_intersect("rules", every).alias("done"), current.alias("old")).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"), F.flatten(F.collect_list("old")).alias("old"))
        blobs = gated.groupBy("blob").agg(F.max("gated").alias("gated"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        lacking = todo.filter(F.size("rules") > 0)
        texts = gated.filter("gated").select("blob", "text").join(lacking.filter("gated").select("blob", "rules"), "blob")
        once = texts.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("text").alias("text"))
        scanned = once.mapInArrow(_scan, f"blob string, rules array<string>, spans {SPAN}")
        clean = lacking.filter("not gated").select("blob", "rules", none.alias("spans"))
        both = seen.select("blob", F.col("old").alias("spans")).unionByName(scanned.select("blob", "spans"))
        known = both.groupBy("blob").agg(in_order(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = paths.join(known.filter(F.size("spans") > 0), "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))
    return findings, scanned.unionByName(clean)


def spans_text(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end, joined by commas."""
    kept = spans if kinds is None else F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
