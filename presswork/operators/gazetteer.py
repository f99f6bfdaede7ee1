"""Entities of a table found in texts: a trie of tokens as joins.

An entity is its tokens (runs of letters, digits and underscores of any script, lower-cased). A text's tokens meet the entities'
first tokens; only there, and only for the lengths that entities with this first token have, are longer runs of tokens looked up.
So the work follows the tokens that may begin an entity, and neither the plan nor a task grows with the entity table.

Of matches that overlap the leftmost counts, of those the longest. Entities without a token are never found; entities that are
equal in tokens are one name with several labels. Null texts hold nothing. Rows of one id are texts of their own.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from .graph import written

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
TOKENS = "array<struct<t:string,s:int,e:int>>"


def _tokens(text: Column) -> Column:
    """Tokens in lower case with where they begin and end, in code points."""
    return F.arrow_udf(_cut, TOKENS)(text)


def _cut(texts: pa.Array) -> pa.Array:
    """One token after the other into flat arrays: a batch holds no object for each token but its text."""
    words, starts, ends, at = [], array("i"), array("i"), array("i", [0])
    for text in texts:
        for m in _TOKEN.finditer(text.as_py() or ""):
            words.append(m.group().lower())
            starts.append(m.start())
            ends.append(m.end())
        at.append(len(words))
    flat = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["t", "s", "e"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat, mask=texts.is_null())


def _leftmost(hits: pa.Array) -> pa.Array:
    """Of each text's hits, ordered by where they begin and the longest first, those that begin after the one before ends."""
    flat = hits.flatten()
    begin, size = flat.field("at").to_pylist(), flat.field("size").to_pylist()
    kept, offsets, i = [], [0], 0
    for n in pa.compute.list_value_length(hits).to_pylist():
        after = 0
        for j in range(i, i + (n or 0)):
            if begin[j] >= after:
                kept.append(j)
                after = begin[j] - size[j]  # sizes are negative
        i += n or 0
        offsets.append(len(kept))
    some = flat.take(pa.array(kept, pa.int64()))
    names = ["start", "end", "labels"]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([some.field(x) for x in names], names))


def _key(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda x: x["t"]), " ")


def find_entities(docs: DataFrame, id_col: str, text_col: str, entities: DataFrame, name_col: str, label_col: str) -> DataFrame:
    """id, start, end (code points, end exclusive), found (as the text has it), labels (sorted): one row for each match."""
    bounded_batches(docs.sparkSession)
    known = entities.select(_tokens(F.col(name_col)).alias("t"), F.col(label_col).alias("label")).filter("size(t) > 0")
    known = known.select(_key("t").alias("name"), F.col("t")[0]["t"].alias("head"), F.size("t").alias("size"), "label")
    known = written(known.groupBy("name", "head", "size").agg(F.sort_array(F.collect_set("label")).alias("labels")))
    heads = known.groupBy("head").agg(F.sort_array(F.collect_set("size")).alias("sizes"))  # as many sizes as the longest entity has tokens at most
    own = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    longest = known.agg(F.max("size")).first()[0] or 1  # one number
    # each token with those after it, cut before they become rows: no row holds the whole text's tokens
    runs_of = F.transform("t", lambda x, i: F.struct(i.alias("at"), x["t"].alias("head"), F.slice(F.col("t"), i + 1, F.lit(longest)).alias("t")))
    tails = own.select("row", _tokens(F.col("text")).alias("t")).select("row", F.inline(runs_of))
    begun = tails.join(heads, "head").select("row", "at", "t", F.explode("sizes").alias("size")).filter("size(t) >= size")
    runs = begun.select("row", "at", "size", F.expr("slice(t, 1, size)").alias("t")).select("row", "at", "size", _key("t").alias("name"), F.col("t")[0]["s"].alias("start"), F.element_at("t", -1)["e"].alias("end"))
    hits = runs.join(known.select("name", "labels"), "name")
    one = F.struct("at", (-F.col("size")).alias("size"), "start", "end", "labels")
    picked = F.arrow_udf(_leftmost, "array<struct<start:int,end:int,labels:array<string>>>")("m")
    kept = hits.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("m")).select("row", picked.alias("m"))
    return own.join(kept, "row").select("id", "text", F.explode("m").alias("m")).select("id", "m.start", "m.end", F.expr("substring(text, m.start + 1, m.end - m.start)").alias("found"), "m.labels")
