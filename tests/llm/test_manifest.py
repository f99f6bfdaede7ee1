"""The manifest against a plain tree built in memory."""

import hashlib
import random
import zlib

import pytest
from presswork.llm import manifest, queries
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, paths):
    """nodes: [(digest, members)]; appends (side, sibling) to the members' paths and returns the top."""
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j, (_, members) in enumerate(run):
                other = run[1 - j][0] if len(run) == 2 else None
                for m in members:
                    paths[m].append((j == 1, other))
            up.append((sha(*(d for d, _ in run)), [m for _, ms in run for m in ms]))
        nodes = up
    return nodes[0]


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    paths = [[] for _ in rows]
    digests = [leaf(r) for r in rows]
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    tops, sub = [], {}
    for lang in langs:
        own = sorted((i for i, r in enumerate(rows) if r[2] == lang), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, digests[i]))
        tops.append(climb([(digests[i], [i]) for i in own], paths))
        sub[lang] = tops[-1][0]
    root = climb(tops, paths)[0]
    out = []
    for i, r in enumerate(rows):
        now = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
            now[3] += 1
        acc = leaf(now)
        for left, other in paths[i]:
            acc = sha(acc) if other is None else sha(other, acc) if left else sha(acc, other)
        out.append((r[0], digests[i], sub[r[2]], root, sha(*(o for _, o in paths[i] if o)), acc, acc == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op13(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    out = queries.op13_manifest(spark, FOLDER)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] + ["string"] * 5 + ["boolean"]
    want = plain([tuple(r) for r in docs.collect()])
    assert got(out) == want
    assert {r[6] for r in want} == {True, False}


def random_rows(n, langs, seed=13):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(-3, 5), *range(100, 100 + n)]), rng.choice([None, "", "s"]), rng.choice(langs), rng.choice([None, 0, 7, 2**63 - 1]), rng.choice([None, "", "a b", "é\n", "x" * 5000])) for _ in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n, langs", [(1, ["de"]), (2, [None]), (2, [None, ""]), (60, ["de"]), (333, [None, "", "de", "en", "é", "￿", "\U00010000"]), (120, [f"l{i}" for i in range(90)])])
def test_odd(spark, tmp_path, n, langs):
    rows = random_rows(n, langs)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", leaf int, grp string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op13_manifest(spark, str(tmp_path))) == plain(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_manifest(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("bits, top", [(1, 400), (2, 5), (3, 1), (1, 1), (4, 20)])
def test_blocks_of_blocks(spark, bits, top):
    """However the tree is divided between executors and driver, paths and root are the same."""
    rows = random_rows(90, [None, "de", "en", *map(str, range(12))])
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = df.select("doc_id", "lang", manifest.digest(*(F.col(c) for c in df.columns)).alias("leaf"))
    out = manifest.prove(leaves, "lang", "doc_id", bits, top)
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), manifest.folded(F.col("leaf"), F.col("path")))
    want = plain(rows)
    assert got(out) == sorted([(*r[:5], r[3]) for r in want], key=str)
