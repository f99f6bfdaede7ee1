"""Model calls behind one interface (M3-M5, M14): a provider is a function from Column to Column.

A real model is a pandas_udf with that signature; the providers here are Columns, so everything runs without a network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bias_json
from ..functions import heuristics as h
from ..functions.text import let, sentences

Provider = Callable[[Column], Column]
FIELDS = (("dl", "dir", "L"), ("dc", "dir", "C"), ("dr", "dir", "R"), ("gl", "deg", "L"), ("gm", "deg", "M"), ("gh", "deg", "H"))


def infer_bias(text: Column, model: Provider, default: Provider = h.bias) -> Column:
    """struct dl, dc, dr, gl, gm, gh, reason, how (strict, repaired or heuristic).

    The model's answer if it is a whole record; else what repair makes of it, if that is one; else the default's.
    """

    def merged(y: Column) -> Column:
        how = F.when(y["strict"].isNotNull(), "strict").when(y["repaired"].isNotNull(), "repaired").otherwise("heuristic")
        either = lambda answer, other: F.when(y["record"].isNotNull(), answer).otherwise(other)
        fields = [either(y["record"][axis][key], y["own"][name]).alias(name) for name, axis, key in FIELDS]
        return F.struct(*fields, either(y["record"]["reason"], y["own"]["reason"]).alias("reason"), how.alias("how"))

    def judged(x: Column) -> Column:
        record = F.from_json(F.coalesce(x["strict"], x["repaired"]), bias_json.SHAPE)
        return let(F.struct(x["strict"].alias("strict"), x["repaired"].alias("repaired"), record.alias("record"), default(text).alias("own")), merged)

    return let(model(text), lambda raw: let(F.struct(bias_json.canonical(raw).alias("strict"), bias_json.canonical(bias_json.repair_json(raw)).alias("repaired")), judged))


def ask(text: Column, prompt: str, provider: Provider, limit: int = 2_000) -> Column:
    """The provider's answer to the prompt and the first `limit` characters of the text; null for a null text."""
    return provider(F.concat(F.lit(prompt), F.substring(text, 1, limit)))


def targeted_tone(docs: DataFrame, id_col: str, text_col: str, tag: Provider) -> DataFrame:
    """id, name, tone, n: for each entity of a text (tag gives text and label), how many sentences with it have which tone."""
    held = docs.select(F.col(id_col).alias("id"), F.explode(tag(F.col(text_col))).alias("e"), sentences(F.col(text_col)).alias("s"))
    each = held.select("id", F.col("e.text").alias("name"), F.explode("s").alias("s")).filter(F.contains(F.lower("s"), F.lower("name")))
    tone = F.regexp_replace(h.tone(F.col("s")), "neutral", "indifferent")
    return each.groupBy("id", "name", tone.alias("tone")).agg(F.count("*").alias("n"))


def dominant(b: Column) -> Column:
    return F.when(b["dl"] >= F.greatest(b["dc"], b["dr"]), "L").when(b["dc"] >= b["dr"], "C").otherwise("R")


def compare_bias(docs: DataFrame, id_col: str, text_col: str, first: Provider, second: Provider) -> DataFrame:
    """id, apart (sum of differences of direction), same (the same direction leads) of two providers' answers."""
    both = docs.select(F.col(id_col).alias("id"), first(F.col(text_col)).alias("a"), second(F.col(text_col)).alias("b"))
    apart = sum((F.abs(F.col("a")[x] - F.col("b")[x]) for x in ("dl", "dc", "dr")), F.lit(0.0))
    return both.select("id", F.round(apart, 6).alias("apart"), (dominant(F.col("a")) == dominant(F.col("b"))).alias("same"))


class BiasTools:
    """The calls that a client makes (M14): one text, a table, a folder of files, two providers, and what is loaded."""

    def __init__(self, spark, name: str = "keywords", model: Provider | None = None):
        self.spark, self.name, self.model = spark, name, model

    def analyze_bias(self, text: str) -> dict:
        return self.analyze_batch(self.spark.createDataFrame([(0, text)], "id int, text string"), "id", "text").drop("id").first().asDict()

    def analyze_batch(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        model = self.model or (lambda c: F.lit(None).cast("string"))
        return docs.select(F.col(id_col).alias("id"), infer_bias(F.col(text_col), model).alias("b")).select("id", "b.*")

    def analyze_file(self, path: str) -> DataFrame:
        """path, and the answer, of each text file below a folder, or of one file."""
        from ..sources.readers import text_folder

        return self.analyze_batch(text_folder(self.spark, path), "path", "text").withColumnRenamed("id", "path")

    def compare_bias(self, docs: DataFrame, id_col: str, text_col: str, other: Provider) -> DataFrame:
        return compare_bias(docs, id_col, text_col, lambda c: infer_bias(c, self.model or (lambda x: F.lit(None).cast("string"))), other)

    def get_model_info(self) -> dict:
        return {"name": self.name, "loaded": self.model is not None, "fallback": "keywords"}

    def unload_model(self) -> None:
        self.model = None
