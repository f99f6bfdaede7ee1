"""License scans by diagonal voting.

Every k-word gram of a text is hashed and joined in Spark with the positions of the same gram in license templates. A
match votes for its diagonal, text position minus template position. Votes are summed by diagonal; neighbouring
diagonals (words inserted or left out) are merged; a merged span is verified by how many distinct template positions it
covers. A phrase (a template that must stand word by word) needs all its grams on one diagonal.

The grams of the templates are a fixed, small table (a few hundred rows), so it is broadcast; texts are not shuffled,
only votes are. Null texts have no words; rows equal in id and text have equal results; a span of several labels has
all of them; very long texts are a chunk of their own; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textvec import ALNUM, Words, chunks, grams, inside

K = 3
#: Diagonals that differ by so many words or less belong together.
SLACK = 4
#: Share of a template's grams that a span must cover.
COVER = 0.6
#: Phrases that must stand word by word, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Beginnings and notices of well-known licenses.
TEMPLATES = (
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _text_grams(texts: list[str]) -> list[list[int]]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    out = []
    for chunk in chunks(iter([batch])):
        words = Words(chunk, ALNUM)
        h, ok = grams(words.hashes(lower=True), K), inside(words, K)
        out += [h[a : max(a, b - K + 1)][ok[a : max(a, b - K + 1)]].view(np.int64).tolist() for a, b in zip(words.row[:-1], words.row[1:], strict=True)]
    return out


def template_table(spark) -> DataFrame:
    """h, template, at, n (grams of the template), label, phrase (1 if it must stand word by word)."""
    rows = []
    for i, (grams_, (label, phrase)) in enumerate(zip(_text_grams([t for t, _ in PHRASES] + [t for _, t in TEMPLATES]), [(x, 1) for _, x in PHRASES] + [(x, 0) for x, _ in TEMPLATES], strict=True)):
        rows += [(h, i, at, len(grams_), label, phrase) for at, h in enumerate(grams_)]
    return spark.createDataFrame(rows, "h long, template int, at int, n int, label string, phrase int")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text"):
        words = Words(chunk, ALNUM)
        at = np.flatnonzero(inside(words, K))
        h = grams(words.hashes(lower=True), K)[at] if len(at) else np.zeros(0, np.uint64)
        owner = pa.array(words.doc[at])
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id").take(owner), chunk.column("text_key").take(owner), pa.array(words.place[at].astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "text_key", "pos", "h"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("text_key"), pa.array(Words(chunk, ALNUM).count.astype(np.int64))], ["doc_id", "text_key", "n_words"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (of phrases, in order), base_labels, labels, score: one row for each row of docs.

    score is the largest share of a template that is covered, 0 without a label.
    """
    # equal texts under one id have equal results, so id and text hash are key enough
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    key = ["doc_id", "text_key"]
    every = rows.mapInArrow(_grams, f"doc_id {kind}, text_key long, pos int, h long")
    hits = every.join(F.broadcast(template_table(docs.sparkSession)), "h").withColumn("diagonal", F.col("pos") - F.col("at"))
    lines = hits.groupBy(*key, "template", "label", "phrase", "n", "diagonal").agg(F.collect_set("at").alias("covered"))
    in_order = Window.partitionBy(*key, "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > F.when(F.col("phrase") == 1, 0).otherwise(SLACK), F.lit(True))
    spans = (
        lines.withColumn("span", F.sum(new.cast("int")).over(in_order))
        .groupBy(*key, "template", "label", "phrase", "n", "span")
        .agg(F.min("diagonal").alias("start"), (F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.max("n")).alias("share"))
        .filter(F.col("share") >= F.when(F.col("phrase") == 1, 1.0).otherwise(COVER))
    )
    base = F.col("phrase") == 1
    found = spans.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(base, F.col("start")))).alias("places"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    ).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    counted = rows.mapInArrow(_counts, f"doc_id {kind}, text_key long, n_words long")
    none = F.array().cast("array<string>")
    return counted.join(found, counted["doc_id"].eqNullSafe(found["_id"]) & (counted["text_key"] == found["_key"]), "left").select(
        "doc_id", "n_words", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
