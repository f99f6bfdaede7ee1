"""Word-list heuristics over whole texts (F20-F23, T13, T14, M2-M5), and model calls with their offline providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import heuristics as h
from ..operators import inference, models
from .registry import query
from .stories import STORIES, stories


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _present(words, low: str = "lower(text)") -> str:
    return " + ".join(f"CAST(contains({low}, '{w}') AS INT)" for w in words)


def _any(words, low: str) -> str:
    return " OR ".join(f"contains({low}, '{w}')" for w in words)


def _times(words) -> str:
    return " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in words)


PEOPLE = f"list_sort(list_distinct(list_concat(regexp_extract_all(text, '{h.TITLED}', 1), regexp_extract_all(text, '{h.LINKED}', 1))))"
TOPICS = "list_filter([" + ", ".join(f"CASE WHEN {_any(words, 'lower(text)')} THEN '{name}' END" for name, words in h.TOPICS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {STORIES} SELECT id, array_to_string({PEOPLE}, ', ') AS people, array_to_string(list_filter({_list(h.PLACES)}, lambda p: contains(text, p)), ', ') AS places, array_to_string({TOPICS}, ', ') AS topics FROM stories")
def F20_people_places_topics(t):
    text = F.col("text")
    return stories(t).select("id", *(F.array_join(f(text), ", ").alias(name) for f, name in ((h.people, "people"), (h.places, "places"), (h.topics, "topics"))))


@query(f"WITH {STORIES} SELECT id, CASE WHEN n > p THEN 'negative' WHEN p > n THEN 'positive' ELSE 'neutral' END AS tone FROM (SELECT id, {_times(h.POSITIVE)} AS p, {_times(h.NEGATIVE)} AS n FROM stories)")
def F21_tone(t):
    return stories(t).select("id", h.tone(F.col("text")).alias("tone"))


SMALL = "round(greatest(0.0, 1 - {0} * 0.8 - c * 0.5 - 0.1), 2)"
BIAS = f"""counted AS (SELECT *, {_present(h.LEFT)} AS nl, {_present(h.RIGHT)} AS nr, {_present(h.CENTER)} AS nc FROM stories),
 shares AS (SELECT *, nl + nr + nc AS total, CAST(nl AS DOUBLE) / nullif(nl + nr + nc, 0) AS l, CAST(nr AS DOUBLE) / nullif(nl + nr + nc, 0) AS r, CAST(nc AS DOUBLE) / nullif(nl + nr + nc, 0) AS c FROM counted),
 raw AS (SELECT *, CASE WHEN l > r AND l > c THEN round(l * 0.8 + 0.1, 2) WHEN r > l AND r > c THEN {SMALL.format('r')} ELSE round(l, 2) END AS x,
  CASE WHEN l > r AND l > c OR r > l AND r > c THEN round(c * 0.5, 2) ELSE round(c + 0.1, 2) END AS y, CASE WHEN l > r AND l > c THEN {SMALL.format('l')} WHEN r > l AND r > c THEN round(r * 0.8 + 0.1, 2) ELSE round(r, 2) END AS z FROM shares),
 judged AS (SELECT *, CASE WHEN total = 0 THEN 0.33 ELSE round(x / (x + y + z), 2) END AS dl, CASE WHEN total = 0 THEN 0.34 ELSE round(y / (x + y + z), 2) END AS dc, CASE WHEN total = 0 THEN 0.33 ELSE round(z / (x + y + z), 2) END AS dr,
  CASE WHEN total = 0 THEN 0.33 WHEN total < 5 THEN 0.2 ELSE 0.15 END AS gl, CASE WHEN total = 0 THEN 0.34 WHEN total < 3 THEN 0.6 WHEN total < 5 THEN 0.5 ELSE 0.4 END AS gm, CASE WHEN total = 0 THEN 0.33 WHEN total < 3 THEN 0.2 WHEN total < 5 THEN 0.3 ELSE 0.45 END AS gh,
  CASE WHEN total = 0 THEN 'Insufficient signals for bias detection - defaulted to center' ELSE format('Keyword analysis: {{}} left, {{}} right, {{}} neutral signals', nl, nr, nc) END AS reason FROM raw)"""


@query(f"WITH {STORIES}, {BIAS} SELECT id, CAST(dl AS DOUBLE) AS dl, CAST(dc AS DOUBLE) AS dc, CAST(dr AS DOUBLE) AS dr, CAST(gl AS DOUBLE) AS gl, CAST(gm AS DOUBLE) AS gm, CAST(gh AS DOUBLE) AS gh, reason FROM judged")
def F22_bias_by_keywords(t):
    return stories(t).select("id", h.bias(F.col("text")).alias("b")).select("id", "b.*")


RULES = " ".join(f"WHEN {_any(words, 'lower(name)')} THEN '{c}'" for c, words in h.COLOURS.items())


@query(f"WITH {STORIES}, names AS (SELECT DISTINCT who AS name FROM stories UNION SELECT DISTINCT what FROM stories UNION SELECT DISTINCT place FROM stories) SELECT name, CASE {RULES} ELSE '{h.OTHER_COLOUR}' END AS colour FROM names")
def F23_node_colours(t):
    s = stories(t)
    names = s.select(F.col("who").alias("name")).union(s.select("what")).union(s.select("place")).distinct()
    return names.select("name", h.colour(F.col("name")).alias("colour"))


HAS = "len(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '' AND contains(lower(text), w))) > 0"
VERB = " ".join(f"WHEN {_any(words, 'lower(did)')} THEN {n}" for words, n in h.VERBS)


@query(f"WITH {STORIES}, other AS (SELECT *, lag(who) OVER (PARTITION BY source ORDER BY id) AS before FROM stories) SELECT id, before AS source, place AS target, did AS relation, score FROM (SELECT *, CASE WHEN a AND b THEN 10 + v WHEN a OR b THEN 5 + v END AS score FROM (SELECT *, coalesce({HAS.format('before')}, false) AS a, {HAS.format('place')} AS b, CASE {VERB} ELSE 0 END AS v FROM other)) WHERE score > 3")
def T13_relevant_relations(t):
    from pyspark.sql.window import Window

    before = F.lag("who").over(Window.partitionBy("source").orderBy("id"))
    rows = stories(t).withColumn("before", before)
    score = h.relation_score(F.col("text"), F.coalesce("before", F.lit("")), F.col("place"), F.col("did"))
    return rows.select("id", F.col("before").alias("source"), F.col("place").alias("target"), F.col("did").alias("relation"), score.alias("score")).filter("score > 3")


#: Weights of entity kinds in a picture's description.
WEIGHTS = {"PERSON": 3, "GPE": 2, "ORG": 1}
FOUND = {"PERSON": ("Anna Lee", "John Hill", "Tom Park", "Eve Stone", "Peter Wood"), "GPE": ("Chicago", "New York", "Ankara", "Germany", "Moscow"), "ORG": ("committee", "unions")}
EDGE = "[^\\p{L}\\p{N}_]"
HELD = [(label, e, f"contains(lower(text), '{e.lower()}')" if " " in e else f"regexp_matches(lower(text), '(^|{EDGE}){e.lower()}($|{EDGE})')") for label in sorted(FOUND) for e in FOUND[label]]
TAGGED = "tagged AS (SELECT id, source, text, list_filter([" + ", ".join(f"CASE WHEN {test} THEN struct_pack(label := '{label}', name := '{e}', w := {WEIGHTS[label]}) END" for label, e, test in HELD) + "], lambda x: x IS NOT NULL) AS ents FROM stories)"


@query(f"WITH {STORIES}, {TAGGED} SELECT id, e.label AS label, e.name AS name FROM (SELECT id, unnest(ents) AS e FROM tagged)")
def M2_named_entities(t):
    return stories(t).select("id", F.explode(models.tag_entities(F.col("text"), FOUND)).alias("e")).select("id", "e.label", F.col("e.text").alias("name"))


@query(f"WITH {STORIES}, {TAGGED}, ranked AS (SELECT id, e.name AS name, row_number() OVER (PARTITION BY id ORDER BY e.w DESC, e.name) AS r FROM (SELECT id, unnest(ents) AS e FROM tagged)), three AS (SELECT id, string_agg(name, ', ' ORDER BY r) AS names FROM ranked WHERE r <= 3 GROUP BY 1) SELECT s.id, coalesce('news report background scene featuring: ' || names, 'generic news studio background') AS phrase FROM stories s LEFT JOIN three USING (id)")
def T14_background_phrase(t):
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    each = F.transform(models.tag_entities(F.col("text"), FOUND), lambda e: F.struct((-F.coalesce(F.try_element_at(table, e["label"]), F.lit(0))).alias("w"), e["text"].alias("name")))
    names = F.transform(F.slice(F.array_sort(each), 1, 3), lambda e: e["name"])
    return stories(t).select("id", F.when(F.size(names) > 0, F.concat(F.lit("news report background scene featuring: "), F.array_join(names, ", "))).otherwise("generic news studio background").alias("phrase"))


SENT = "regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
TONE_OF = f"CASE WHEN {_times(h.NEGATIVE)} > {_times(h.POSITIVE)} THEN 'negative' WHEN {_times(h.POSITIVE)} > {_times(h.NEGATIVE)} THEN 'positive' ELSE 'indifferent' END"


@query(f"WITH {STORIES}, {TAGGED}, sent AS (SELECT id, unnest({SENT}) AS text FROM stories), each AS (SELECT id, e.name AS name FROM (SELECT id, unnest(ents) AS e FROM tagged)) SELECT each.id, name, {TONE_OF} AS tone, count(*) AS n FROM each JOIN sent ON each.id = sent.id AND contains(lower(sent.text), lower(name)) GROUP BY 1, 2, 3")
def M3_targeted_tone(t):
    return inference.targeted_tone(stories(t), "id", "text", lambda c: models.tag_entities(c, FOUND))


@query(f"""WITH {STORIES}, {BIAS} SELECT id, CAST(CASE WHEN id % 4 IN (0, 1) THEN (id % 8) / 8.0 ELSE dl END AS DOUBLE) AS dl, CAST(CASE WHEN id % 4 IN (0, 1) THEN 0.5 ELSE dc END AS DOUBLE) AS dc, CAST(CASE WHEN id % 4 IN (0, 1) THEN 0.25 ELSE dr END AS DOUBLE) AS dr, CAST(CASE WHEN id % 4 IN (0, 1) THEN 0.5 ELSE gl END AS DOUBLE) AS gl, CASE WHEN id % 4 IN (0, 1) THEN 'ok' ELSE reason END AS reason, CASE WHEN id % 4 = 0 THEN 'strict' WHEN id % 4 = 1 THEN 'repaired' ELSE 'heuristic' END AS how FROM judged""")
def M4_inferred_bias(t):
    """A model whose answers are good, broken, nonsense or missing, a quarter each."""
    l = F.format_string("%s", (F.col("id") % 8 / 8).cast("string"))
    good = F.concat(F.lit('{"dir":{"L":'), l, F.lit(',"C":0.5,"R":0.25},"deg":{"L":0.5,"M":0.25,"H":0.25},"reason":"ok"}'))
    broken = F.concat(F.lit('"dir":"L":'), l, F.lit(',"C":0.5,"R":0.25,"deg":"L":0.5,"M":0.25,"H":0.25,"reason":"ok'))
    model = lambda c: F.when(F.col("id") % 4 == 0, good).when(F.col("id") % 4 == 1, broken).when(F.col("id") % 4 == 2, "no answer")
    return stories(t).select("id", inference.infer_bias(F.col("text"), model).alias("b")).select("id", "b.dl", "b.dc", "b.dr", "b.gl", "b.reason", "b.how")


@query("SELECT conv_id, turn, md5('Summarise in one sentence: ' || substr(text, 1, 2000)) AS answer FROM conversations")
def M5_provider_answers(t):
    """The provider, here a digest, stands where a model's pandas_udf would; prompts are cut to the model's 2,000 characters."""
    return t.conversations.select("conv_id", "turn", inference.ask(F.col("text"), "Summarise in one sentence: ", F.md5, 2_000).alias("answer"))


@query(f"WITH {STORIES}, {BIAS} SELECT id, round(abs(dl - 0.33) + abs(dc - 0.34) + abs(dr - 0.33), 6) AS apart, CASE WHEN dl >= greatest(dc, dr) THEN 'L' WHEN dc >= dr THEN 'C' ELSE 'R' END = 'C' AS same FROM judged")
def M14_compared_providers(t):
    """The heuristic against a provider that always says center."""
    return inference.compare_bias(stories(t), "id", "text", h.bias, lambda c: h.bias(F.lit("")))
