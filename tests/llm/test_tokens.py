"""Encoding, decoding and alignment against the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from presswork.llm import align, pieces, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import brute

FOLDER = "/root/testdata/sf0.001"
MODEL = vocabularies.path("piece_bpe_32k.model")
#: What the two tokenizers treat in a way of their own.
ODD = [*brute.ODD, " ", "   ", "\n", " a", "a ", "a  b", "a   b\n c", "▁", "a▁b", "▁ ▁", "<s> </s> <unk> <0x0A>", "<|endoftext|>", "x<|endoftext|> y", "it's we'RE 'll", "王芳说 你好", "👩‍👩‍👧 é é", "\x00 \x1c\x1d\x85 \xa0 ᠎   　x", "­​ b", "a" * 5000, " " * 3000, "ab" * 2000 + " c"]
#: Short strings that meet in many pieces.
MORSELS = ["a", "b", "the", "in", " ", "  ", "▁", "\n", "\t", "é", "ß", "王", "😀", "ing", "tion", "0", "12", "<s>", "<0x0A>", "'", "==", "᠎", "\x00", "ا", "    "]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_bytes(MODEL))


def lists(found):
    ids, offsets = found
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_encode_random(lib, model):
    rng = random.Random(12)
    texts = ["".join(rng.choice(MORSELS) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += ["".join(rng.choice("abcdehinorst e") for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    texts += [t or "" for t in ODD]
    assert lists(pieces.Encoder(model).encode(texts)) == lib.encode(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_round_trip(texts):
    tables = pieces.loaded(pieces.model_bytes(MODEL))
    ids, offsets = pieces.encoder(pieces.model_bytes(MODEL)).encode(texts)
    back = tables.decode(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))).to_pylist()
    assert back == [t.replace("▁", " ") for t in texts]


def test_long_words(lib, model, monkeypatch):
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123+/") for _ in range(60_000)), " " * 20_000, "a" * 30_000 + " b", "x\n" * 5000]
    want = lib.encode(texts)
    assert lists(pieces.Encoder(model).encode(texts)) == want
    for rounds in (0, 1, 3):  # the queue gives what rounds give, wherever it takes over
        monkeypatch.setattr(pieces, "ROUNDS", rounds)
        assert lists(pieces.Encoder(model).encode(texts[:1] + ["the thing in the string  inside"])) == [want[0], lib.encode("the thing in the string  inside")]


def test_texts_in_slices(lib, model, monkeypatch):
    monkeypatch.setattr(pieces, "_SLICE", 7)
    texts = [t or "" for t in ODD if len(t or "") < 4000]
    for t in texts:
        assert " ".join(p for run in pieces.cut_text(t) for p in run) == t
    assert lists(pieces.Encoder(model).encode(texts)) == lib.encode(texts)


def test_forgetting(lib, model, monkeypatch):
    monkeypatch.setattr(pieces, "_KNOWN", 5)
    own, rng = pieces.Encoder(model), random.Random(15)
    for _ in range(30):
        texts = [rng.choice(ODD[:30]) for _ in range(rng.randint(0, 4))]
        assert lists(own.encode(texts)) == [lib.encode(t or "") for t in texts]


def test_columns(spark, lib):
    data = queries.vocabulary("piece_bpe_32k.model")
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    out = df.select("text", pieces.piece_ids(F.col("text"), data).alias("ids")).select("text", "ids", pieces.piece_text(F.col("ids"), data).alias("back"))
    for r in out.collect():
        assert r["ids"] == lib.encode(r["text"] or "") and r["back"] == lib.decode(r["ids"])


def test_decode_any_ids(lib, model):
    rng = random.Random(14)
    ids = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 20))] for _ in range(8000)]
    assert model.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [lib.decode(x) for x in ids]
    odd = pa.array([[5], None, [], [None, 300, None], [0, 1, 2]], pa.list_(pa.int32()))
    assert model.decode(odd).to_pylist() == [lib.decode([5]), "", "", lib.decode([300]), lib.decode([0, 1, 2])]
    assert model.decode(odd.slice(3)).to_pylist() == [lib.decode([300]), lib.decode([0, 1, 2])]
    with pytest.raises(ValueError):
        model.decode(pa.array([[32000]], pa.list_(pa.int32())))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def encoded(lib, rows):
    out = []
    for i, t in rows:
        ids = lib.encode(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    return sorted(out, key=str)


def test_op12(spark, lib):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.op12_pieces(spark, FOLDER)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "string", "string"]
    assert sorted(map(tuple, got.collect()), key=str) == encoded(lib, docs.select("doc_id", "text").collect())


def test_op12_odd(spark, lib, tmp_path):
    rows = [*enumerate(ODD), (None, "a b"), (1, "a b"), (1, "a b"), (None, None)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op12_pieces(spark, str(tmp_path)).collect()), key=str) == encoded(lib, rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_pieces(spark, f"{tmp_path}/none").collect() == []


def plain_alignment(rows):
    """Whole texts, all pairs of overlapping ranges, counted in one table."""
    a_tok = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    byte = {}
    fill = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            byte[chr(b)] = b
        else:
            byte[chr(fill)] = b
            fill += 1
    found, count = [], Counter()
    for i, t in rows:
        a, b = [], []
        if t:
            a = [(x, bytes(byte[c] for c in a_tok.id_to_token(x))) for x in a_tok.encode(" " + t, add_special_tokens=False).ids]
            for x in b_tok.encode(t):
                p = b_tok.id_to_piece(x)
                b.append((x, bytes([int(p[1:-1], 16)]) if b_tok.is_byte(x) else p.replace("▁", " ").encode()))
            if not b"".join(x[1] for x in a) == b"".join(x[1] for x in b) == (" " + t).encode():
                a, b = [], []
        ranges = []
        for toks in (a, b):
            at, own = 0, []
            for x, s in toks:
                own.append((at, at + len(s), x))
                at += len(s)
            ranges.append(own)
        links = []
        k = 0
        for s, e, x in ranges[0]:
            while k and ranges[1][k][0] > s:
                k -= 1
            j = k
            while j < len(ranges[1]) and ranges[1][j][0] < e:
                if ranges[1][j][1] > s:
                    links.append((x, ranges[1][j][2]))
                    k = j
                j += 1
        ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x) for s, f, x in own if low <= s and f <= e) for own in ranges) if len(ends) < 400 else None)
            low = e
        if len(ends) >= 400:  # the same, walked once
            groups = []
            at = [0, 0]
            for e in ends:
                sides = []
                for side, own in enumerate(ranges):
                    ids = []
                    while at[side] < len(own) and own[at[side]][1] <= e:
                        ids.append(str(own[at[side]][2]))
                        at[side] += 1
                    sides.append(",".join(ids))
                groups.append("|".join(sides))
        found.append((i, len(a), len(b), groups, links))
        count.update(links)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for i, na, nb, groups, links in found:
        best = sum(count[x] == top[x[1]] for x in links)
        out.append((i, na, nb, len(groups), len(links), best, sum(count[x] for x in links), sha(";".join(groups)) if na else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op11(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_alignment(spark, FOLDER).select(*COLUMNS)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment([tuple(r) for r in docs])


def test_op11_odd(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    rows = [*enumerate(ODD), (None, "a b"), (1, "a b"), (1, "a b"), (None, None)]
    rows += [(100 + i, "".join(rng.choice(MORSELS) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, n_a int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_alignment(rows)
    assert sorted(map(tuple, queries.op11_alignment(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str) == want
    a, b = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
    found = queries.written(align.align(spark.read.parquet(f"{tmp_path}/documents.parquet"), a, b, block=500))  # many small blocks
    out = align.rate(found, align.pair_counts(found)).withColumn("groups_sha256", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)))
    assert sorted(map(tuple, out.select(*COLUMNS).collect()), key=str) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_alignment(spark, f"{tmp_path}/none").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=12), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=6))
def test_interval_index(intervals, ranges):
    have = sorted((s, s + n) for s, n in intervals)
    index = align.IntervalIndex(np.array([s for s, _ in have], int), np.array([e for _, e in have], int))
    low, high = np.array([s for s, _ in ranges], int), np.array([s + n for s, n in ranges], int)
    q, h = index.overlaps(low, high)
    assert list(zip(q.tolist(), h.tolist(), strict=True)) == [(i, j) for i, (s, n) in enumerate(ranges) for j, (a, b) in enumerate(have) if n and b > a and a < s + n and b > s]
