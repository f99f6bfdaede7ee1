"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, language, licenses, manifest, mixing, overlap, pieces, pii, quality, repeats, secrets, toxicity
from .shared import table, written

#: Stands in where the session names no key, as in tests. Set spark.presswork.surrogateKey to a secret of your own.
KEY = b"presswork surrogate key"


def surrogate_key(spark: SparkSession) -> bytes:
    own = spark.conf.get("spark.presswork.surrogateKey", None)
    return own.encode() if own else KEY


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    findings, _ = secrets.scan_versions(docs.select(F.col("doc_id").alias("path"), "text"))
    base = tuple(kind for kind, *_ in secrets.BASE_RULES)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings.select(F.col("path").alias("doc_id"), *map(count, base), F.sha2(secrets.spans_text(F.col("spans"), base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.near_pairs(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), n=20).drop("kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = language.train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    out = language.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.distinct(lambda key: pii.replace_pii(docs, key), surrogate_key(spark))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxic_index(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> toxicity.Index:
    known = labels.filter(fold("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return toxicity.train(docs, known)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxic_index(spark, docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.to_json("neighbours").alias("evidence"))


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file."""
    import public_tokenizers

    return pieces.model_bytes(public_tokenizers.path(name))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = align.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    found = written(found.withColumn("groups_sha256", digest).drop("groups"))
    return align.rate(found, written(align.pair_counts(found)), keep=("groups_sha256",))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = docs.select("doc_id", pieces.round_trip(F.col("text"), vocabulary("piece_bpe_32k.model")).alias("back"))
    return back.select(
        "doc_id",
        F.size("back.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("back.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("back.text", 256).alias("decoded_sha256"),
    )


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda chars: manifest.digest(*(F.col(c) for c in ("doc_id", "source", "lang")), chars, F.col("text"))
    changed = F.when(fold("doc_id", 7) == 0, fields(F.col("n_chars").cast("decimal(20,0)") + 1))
    leaves = docs.select("doc_id", "lang", fields(F.col("n_chars")).alias("leaf"), changed.alias("changed"))
    out = manifest.prove(leaves, "lang", "doc_id")
    out = out.withColumn("folded_root", manifest.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_secret_scan, op3_jaccard_join, op3_jaccard_pairs, op4_repeats, op5_language, op6_quality, op7_licenses, op8_surrogates, op9_decontamination, op10_toxicity, op11_alignment, op12_pieces, op13_manifest)}

ORACLES: dict[str, str] = {}
