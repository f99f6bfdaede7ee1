"""Text forms of records: entity blocks, bias blocks, compact JSON, exports, prompts (F17, F44-F46, F55, K9, M16), as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_block(entities: Column) -> Column:
    """<entities> with a line for each label, labels and texts in order and once; (none) if there are none. entities: text, label."""
    labels = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["label"])))
    texts = lambda label: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(entities, lambda e: e["label"] == label), lambda e: e["text"]))), ", ")
    lines = F.array_join(F.transform(labels, lambda label: F.concat(label, F.lit(": "), texts(label))), "\n")
    return F.concat(F.lit("<entities>\n"), F.when(F.size(entities) > 0, lines).otherwise("(none)"), F.lit("\n</entities>"))


def _axis(name: str, values: Column) -> Column:
    """"Name: K: 0.00, ..." with the keys that are there in order; null without the axis."""
    each = F.transform(F.array_sort(F.map_keys(values)), lambda k: F.format_string("%s: %.2f", k, F.try_element_at(values, k)))
    return F.when(values.isNotNull(), F.concat(F.lit(f"{name}: "), F.array_join(each, ", ")))


def bias_block(raw: Column) -> Column:
    """<bias> with direction, degree and reason of a record in JSON; other text as it is; (none) if null or empty."""
    x = F.from_json(raw, "dir map<string, double>, deg map<string, double>, reason string")
    record = F.concat_ws("\n", _axis("Direction", x["dir"]), _axis("Degree", x["deg"]), F.concat(F.lit("Reason: "), x["reason"]))
    is_object = F.try_parse_json(raw).isNotNull() & F.startswith(F.ltrim(raw), F.lit("{"))
    body = F.when(F.coalesce(raw, F.lit("")) == "", "(none)").when(is_object, record).otherwise(raw)
    return F.concat(F.lit("<bias>\n"), body, F.when(is_object & (record == ""), "").otherwise("\n"), F.lit("</bias>"))


def compact_json(raw: Column) -> Column:
    """Without blanks between its parts; {} for null, empty or what isn't JSON. Keys come in order.

    The parser stops after a first value, so the text is read as the one element of an array.
    """
    v = F.try_parse_json(F.concat(F.lit("["), F.nullif(F.trim(raw), F.lit("")), F.lit("]")))
    one = F.try_variant_get(v, "$[1]", "variant").isNull()
    return F.coalesce(F.when(one, F.to_json(F.try_variant_get(v, "$[0]", "variant"))), F.lit("{}"))


#: What stands for a missing record.
DEFAULTS = {"direction": (("L", 0.33), ("C", 0.34), ("R", 0.33)), "degree": (("L", 0.33), ("M", 0.34), ("H", 0.33))}


def canonical_with_defaults(raw: Column) -> Column:
    """struct dl, dc, dr, gl, gm, gh, reasoning: each axis under its long or short name, or its default; no record gives all defaults."""
    axis = "struct<L: double, C: double, R: double>", "struct<L: double, M: double, H: double>"
    x = F.from_json(raw, f"direction {axis[0]}, dir {axis[0]}, degree {axis[1]}, deg {axis[1]}, reasoning string, reason string")
    out = []
    for name, short, cols in (("direction", "dir", ("dl", "dc", "dr")), ("degree", "deg", ("gl", "gm", "gh"))):
        own = F.coalesce(x[name], x[short])
        out += [F.when(own.isNull(), value).otherwise(own[key]).alias(col) for (key, value), col in zip(DEFAULTS[name], cols, strict=True)]
    told = F.coalesce(F.nullif(x["reasoning"], F.lit("")), F.nullif(x["reason"], F.lit("")), F.lit("From MongoDB record"))
    return F.struct(*out, F.when(F.coalesce(raw, F.lit("")) == "", "No bias data").otherwise(told).alias("reasoning"))


def is_valid_bias(raw: Column) -> Column:
    """Whether a record has both axes with three numbers each and a reason that isn't blank."""
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    ok = kind("$.reason") == "STRING"
    for axis, keys in (("dir", "LCR"), ("deg", "LMH")):
        for k in keys:
            ok = ok & (kind(f"$.{axis}.{k}").isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind(f"$.{axis}.{k}"), F.lit("DECIMAL")))
    return F.coalesce(ok & (F.trim(F.try_variant_get(v, "$.reason", "string")) != ""), F.lit(False))


def article_block(id_: Column, title: Column, published: Column, source: Column, bias: Column, entities: Column, text: Column) -> Column:
    """An article as a block of lines (K9)."""
    time = F.coalesce(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    parts = (("---", None), ("ID: ", id_.cast("string")), ("Title: ", title), ("Published: ", time), ("Source: ", source), ("Bias: ", bias_block(bias)), ("", entity_block(entities)), ("Text: ", text))
    return F.concat_ws("\n", *(F.lit(name) if c is None else F.concat(F.lit(name), F.coalesce(c, F.lit(""))) for name, c in parts))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_js(c: Column) -> Column:
    """Fit to stand in a quoted string of a script."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: The prompts of training rows by kind of model.
INSTRUCTION = "Analyze the political bias of this article. Return JSON with direction (L/C/R probabilities) and degree (L/M/H probabilities)."
SYSTEM = "You are a political bias analysis assistant."


def training_row(kind: str, text: Column, output: Column) -> Column:
    """A training row as JSON for t5, llama, qwen, glm or raw (M16): texts are cut to 1,000 characters for t5, 2,000 for the others, raw has them whole."""
    if kind == "t5":
        row = F.struct(F.concat(F.lit("classify political bias as json: "), F.substring(text, 1, 1000)).alias("input"), output.alias("output"))
    elif kind == "llama":
        row = F.struct(F.lit(INSTRUCTION).alias("instruction"), F.substring(text, 1, 2000).alias("input"), output.alias("output"))
    elif kind == "qwen":
        said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
        row = F.struct(F.array(said("system", F.lit(SYSTEM)), said("user", F.concat(F.lit("Analyze the political bias:\n\n"), F.substring(text, 1, 2000))), said("assistant", output)).alias("messages"))
    elif kind == "glm":
        row = F.struct(F.concat(F.lit("Analyze political bias: "), F.substring(text, 1, 2000)).alias("prompt"), output.alias("response"))
    elif kind == "raw":
        row = F.struct(text.alias("text"), output.alias("bias"))
    else:
        raise ValueError(f"no such kind of model: {kind}")
    return F.to_json(row)
