"""Word-list heuristics over texts: people, places, topics, tone, bias and colours (F20-F23), all as Columns.

Null texts give null lists and the answer of a text without any sign; empty texts too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The patterns of names, and the lists of places, topics, tone, bias and colours.
TITLED = r"\b(?:President|Governor|Mayor|Mr\.|Ms\.|Dr\.)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
LINKED = r"\b(?:by|from|with)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"
PLACES = ("Chicago", "Memphis", "America", "United States", "Tennessee", "Illinois", "Washington", "New York", "Los Angeles", "San Francisco", "Russia", "Ukraine", "Moscow", "Ankara", "Germany", "Turkey")
TOPICS = {"crime": ("crime", "enforcement"), "politics": ("Trump", "administration"), "immigration": ("immigration",), "military": ("National Guard", "troops"), "city": ("city", "Mayor")}
POSITIVE = ("approval", "support", "peace", "ceasefire")
NEGATIVE = ("rejected", "war zones", "killed", "attack", "violation")
LEFT = ("progressive", "liberal", "democrat", "equality", "climate", "healthcare", "social", "workers", "unions", "immigration", "environment", "renewable", "green", "welfare", "civil rights")
RIGHT = ("conservative", "republican", "tradition", "freedom", "capitalism", "business", "taxes", "border", "family", "faith", "gun", "second amendment", "free market", "deregulation", "austerity")
CENTER = ("report", "according to", "officials said", "statement", "announced", "conference", "meeting", "committee")
COLOURS = {
    "#3498db": ("king", "queen", "president", "minister", "governor", "prime minister", "chief", "director", "ceo", "chairman", "bishop", "archbishop", "barrister", "spokesperson", "leader", "founder", "administrator"),
    "#e74c3c": ("party", "government", "department", "agency", "ngo", "cartel", "parliament", "assembly", "council", "un", "eu", "church", "military"),
    "#2ecc71": ("city", "state", "country", "border", "island", "ocean", "sea", "river", "mountain", "pass", "texas", "mexico", "uk", "us", "venezuela"),
}
OTHER_COLOUR = "#f39c12"
#: Scores of a relation's verbs, the first that is in it.
VERBS = ((("killed", "attacked"), 8), (("ordered", "announced"), 6), (("brokered", "mediated"), 4))


def people(text: Column) -> Column:
    """Names after a title, and full names after by, from or with; sorted, each once."""
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (TITLED, LINKED)))))


def _those(words: tuple[str, ...], held) -> Column:
    return F.filter(F.array(*map(F.lit, words)), held)


def places(text: Column) -> Column:
    """The known places that the text holds as they are written, in the list's order."""
    return F.when(text.isNotNull(), _those(PLACES, lambda p: F.contains(text, p)))


def topics(text: Column) -> Column:
    """Topics of which the lower-cased text holds a key; keys with capitals never match."""
    low = F.lower(text)
    each = [F.when(_any(low, words), F.lit(name)) for name, words in TOPICS.items()]
    return F.when(text.isNotNull(), F.filter(F.array(*each), lambda x: x.isNotNull()))


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def occurrences(low: Column, words: tuple[str, ...]) -> Column:
    """How often the words are in the text, without overlap of a word with itself."""
    return sum(((F.length(low) - F.length(F.replace(low, F.lit(w)))) / len(w) for w in words), F.lit(0.0))


def tone(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    low = F.coalesce(F.lower(text), F.lit(""))
    p, n = occurrences(low, positive), occurrences(low, negative)
    return F.when(n > p, "negative").when(p > n, "positive").otherwise("neutral")


def _present(low: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def bias(text: Column) -> Column:
    """struct dl, dc, dr, gl, gm, gh, reason from how many words of each side the text holds."""
    counts = let(F.coalesce(F.lower(text), F.lit("")), lambda low: F.struct(*(_present(low, words).alias(n) for n, words in (("l", LEFT), ("r", RIGHT), ("c", CENTER)))))
    return let(counts, lambda x: let(F.struct(x.alias("n"), (x["l"] + x["r"] + x["c"]).alias("total")), _judged))


def _judged(x: Column) -> Column:
    total = x["total"]
    l, r, c = (F.try_divide(x["n"][k], total) for k in "lrc")
    big, small = lambda x: F.round(x * 0.8 + 0.1, 2), lambda x: F.round(F.greatest(F.lit(0.0), 1 - x * 0.8 - c * 0.5 - 0.1), 2)
    to_left, to_right = (l > r) & (l > c), (r > l) & (r > c)
    raw = F.struct(
        F.when(to_left, big(l)).when(to_right, small(r)).otherwise(F.round(l, 2)).alias("dl"),
        F.when(to_left | to_right, F.round(c * 0.5, 2)).otherwise(F.round(c + 0.1, 2)).alias("dc"),
        F.when(to_left, small(l)).when(to_right, big(r)).otherwise(F.round(r, 2)).alias("dr"),
    )
    steps = (((0.33, 0.2, 0.2, 0.15), "gl"), ((0.34, 0.6, 0.5, 0.4), "gm"), ((0.33, 0.2, 0.3, 0.45), "gh"))
    degs = [F.when(total == 0, a).when(total < 3, b).when(total < 5, d).otherwise(e).alias(name) for (a, b, d, e), name in steps]
    told = F.format_string("Keyword analysis: %d left, %d right, %d neutral signals", x["n"]["l"], x["n"]["r"], x["n"]["c"])
    reason = F.when(total == 0, "Insufficient signals for bias detection - defaulted to center").otherwise(told)
    share = lambda y, name, none: F.when(total == 0, none).otherwise(F.round(y[name] / (y["dl"] + y["dc"] + y["dr"]), 2)).alias(name)
    return let(raw, lambda y: F.struct(share(y, "dl", 0.33), share(y, "dc", 0.34), share(y, "dr", 0.33), *degs, reason.alias("reason")))


def colour(name: Column) -> Column:
    """The colour of the first list of which the lower-cased name holds a word."""
    low, out = F.lower(name), F.lit(OTHER_COLOUR)
    for c, words in reversed(COLOURS.items()):
        out = F.when(_any(low, words), c).otherwise(out)
    return out


def relation_score(sentence: Column, source: Column, target: Column, relation: Column) -> Column:
    """10 if the sentence holds a word of both ends, 5 if of one, and the score of the relation's verb; null if of none."""
    low = F.lower(sentence)
    has = lambda end: F.exists(F.filter(F.split(F.lower(end), r"\s+"), lambda w: w != ""), lambda w: F.contains(low, w))
    verb = F.lit(0)
    for words, n in reversed(VERBS):
        verb = F.when(_any(F.lower(relation), words), n).otherwise(verb)
    return F.when(has(source) & has(target), 10 + verb).when(has(source) | has(target), 5 + verb)
