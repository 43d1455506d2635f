"""Queries over questions: planning, expansion, classification, similarity, guards, and rules over transcripts.

Questions are the lines of conversations. As the tables' language is invented, two lines of three begin with a phrase of
a fixed list, so that every pattern has something to find; the line before is the question before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import rules, text
from loomline.operators import transcripts
from loomline.operators.ranking import top_per_group
from loomline.plans import sqltext as s
from loomline.registry import Tables, query

QUESTIONS = [
    "What is the title of the thesis?", "Who is the author of the report", "Summarize the project in simple words", "What problem does the system solve?", "List the research questions RQ1 and RQ2", "What are the main objectives?", "Compare Redis versus Postgres",
    "How does the Reasoning Tool work?", "What was the success rate of the evaluation?", "What future work is planned", "Define normalization", "And that one?", "Tell me about Apache Kafka", "What did we decide in the meeting?", "find my notes on OOP", "What is ACID in databases",
    "Write a poem about spring", "hello", "What is your name?", "What salary do you expect, 20 LPA or 150k?", "Tell me about a time you failed", "Why should we hire you for this role?", "Explain how quicksort works", "question 3 from my file", "What does the annual report say about revenue?",
    "verified facts in the knowledge file", "What about it?", "tell me more", "Which projects have you built?", "What is the difference between TCP and UDP?", "", "Is it different then?",
]
STATEMENTS = [
    "SELECT 1", "select * from a; drop table a", "WITH x AS (SELECT 1) SELECT * FROM x;", "-- note\nSELECT a FROM b", "/* delete */ select 2", "WITH x AS (DELETE FROM a) SELECT 1", "UPDATE a SET b = 1", "", "selection of things", "SELECT 'x' ; ", "PRAGMA foreign_keys",
]
PAY = ["", " I want 120k now", " about 20 lpa", " the base salary is open", " $ 5", " 120 meters", " 300 per year"]
CUES = ["", " let us discuss pricing and the contract", " the candidate resume and salary", " sprint backlog and a blocker", " lecture on a theorem, said the professor", " time complexity of the algorithm", " tell me about yourself and my background"]
TITLES = ["", "Sales demo", "Weekly sync", "Seminar", "Coding round"]
TALK = ["", " I think the api module is honestly good, you know.", " Therefore the database function runs async; furthermore I would recommend it.", " kind of actually pretty much done", " let me await the promise of the component"]
_Q = f"""{s.SEGMENTS}, q AS (SELECT conv_id, seq, question, coalesce(lag(question) OVER (PARTITION BY conv_id ORDER BY seq), '') AS previous FROM
(SELECT conv_id, seq, CASE WHEN seq % 3 = 0 THEN text WHEN seq % 3 = 1 THEN {s.listed(QUESTIONS)}[(conv_id * 7 + seq) % {len(QUESTIONS)} + 1] || ' ' || text ELSE {s.listed(QUESTIONS)}[(conv_id * 7 + seq) % {len(QUESTIONS)} + 1] || ' ' || left(text, 6) END AS question FROM segments))"""


def pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def _questions(t: Tables) -> DataFrame:
    phrase = pick(QUESTIONS, F.col("conv_id") * 7 + F.col("seq"))
    asked = F.when(F.col("seq") % 3 == 0, F.col("text")).when(F.col("seq") % 3 == 1, F.concat_ws(" ", phrase, "text")).otherwise(F.concat_ws(" ", phrase, F.left("text", F.lit(6))))
    before = F.lag("question").over(Window.partitionBy("conv_id").orderBy("seq"))
    return transcripts.segments(t.conversations).select("conv_id", "seq", asked.alias("question")).withColumn("previous", F.coalesce(before, F.lit("")))


_CLEAN = rf"trim(regexp_replace(regexp_replace(question, {s.quoted(rules.DOCUMENT_WORDS)}, ' ', 'g'), '\s+', ' ', 'g'))"
_OOP = r"\b(?:oop|o\.o\.p\.|object[- ]oriented)\b"


@query("h32_query_expansion", rf"""WITH {_Q}, c AS (SELECT conv_id, seq, {_CLEAN} AS c FROM q), v AS (SELECT conv_id, seq, unnest([c, CASE WHEN {s.matches("lower(c)", _OOP)} THEN c || ' object oriented programming' END, CASE WHEN {s.matches("lower(c)", _OOP)} THEN c || ' OOP' END,
CASE WHEN {s.matches("lower(c)", chr(92) + "bacid" + chr(92) + "b")} THEN c || ' atomicity consistency isolation durability' END, CASE WHEN {s.matches("lower(c)", chr(92) + "bnormalization" + chr(92) + "b")} THEN c || ' normal forms functional dependency' END]) AS variant FROM c) SELECT DISTINCT conv_id, seq, variant FROM v WHERE variant <> ''""")
def query_expansion(t: Tables) -> DataFrame:
    return _questions(t).select("conv_id", "seq", F.explode(rules.expansions(F.col("question"))).alias("variant"))


def _family(c: str, conversation: bool) -> str:
    meeting = s.matches(c, rules.MEETING) + (f" OR {s.matches(c, rules.CONVERSATION)}" if conversation else "")
    return f"CASE WHEN {meeting} THEN 'meeting' WHEN {s.matches(c, rules.PERSONAL)} THEN 'personal' WHEN {s.matches(c, rules.KNOWLEDGE)} THEN 'knowledge' WHEN {s.matches(c, rules.REFERENCE_FILES)} THEN 'mode' END"


@query("h36_query_plan", f"""WITH {_Q}, f AS (SELECT conv_id, seq, question, {_family("question", True)} AS own, {_family("previous", False)} AS before, {s.matches("question", rules.STUB)} OR ({s.matches("question", rules.REFERENTIAL_START)} AND {s.matches("question", rules.REFERENTIAL_WORD)}) AS ref FROM q),
r AS (SELECT *, coalesce(own, CASE WHEN ref AND before IS NOT NULL THEN 'follow_up' WHEN ref THEN 'conversation' ELSE 'default' END) AS reason FROM f)
SELECT conv_id, seq, reason, CASE WHEN {" OR ".join(s.matches("question", p) for p in (rules.MEETING, rules.PERSONAL, rules.REFERENCE_FILES, rules.KNOWLEDGE))} OR (NOT {s.matches("question", rules.CHITCHAT)} AND reason NOT IN ('conversation', 'default')) THEN 'retrieve' ELSE 'skip' END AS retrieval FROM r""")
def query_plan(t: Tables) -> DataFrame:
    return _questions(t).select("conv_id", "seq", rules.query_plan(F.col("question"), F.col("previous")).alias("p")).select("conv_id", "seq", "p.reason", "p.retrieval")


@query("h38_question_types", f"WITH {_Q} SELECT conv_id, seq, {s.first_match('lower(question)', rules.QUESTION_TYPES, chr(39) + 'general' + chr(39))} AS kind FROM q")
def question_types(t: Tables) -> DataFrame:
    return _questions(t).select("conv_id", "seq", rules.question_type(F.col("question")).alias("kind"))


@query("h40_card_questions", rf"""WITH {_Q}, e AS (SELECT conv_id, seq, question, len(list_distinct(regexp_extract_all(question, {s.quoted(rules.ENTITY)}))) AS entities FROM q)
SELECT conv_id, seq, entities, CASE WHEN trim(question) = '' THEN 'unknown' WHEN {s.matches("question", rules.FOLLOW_UP)} AND len(regexp_split_to_array(trim(question), '\s+')) <= 6 THEN 'follow_up' ELSE {s.first_match("question", rules.CARD_TYPES, "CASE WHEN entities > 0 THEN 'entity_lookup' ELSE 'unknown' END")} END AS kind FROM e""")
def card_questions(t: Tables) -> DataFrame:
    q = F.col("question")
    return _questions(t).select("conv_id", "seq", F.size(rules.target_entities(q)).cast("long").alias("entities"), rules.card_question_type(q).alias("kind"))


@query("b16_select_guard", rf"""WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace({s.listed(STATEMENTS)}[doc_id % {len(STATEMENTS)} + 1] || CASE WHEN doc_id % 2 = 0 THEN text ELSE left(text, 9) END, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g')) AS b FROM documents), o AS (SELECT doc_id, b, regexp_replace(b, ';\s*$', '') AS o FROM b)
SELECT doc_id, b <> '' AND NOT contains(o, ';') AND regexp_matches(lower(o), '^(select|with)\b') AND NOT {s.matches("o", rules.DENIED_VERBS)} AS ok FROM o""")
def select_guard(t: Tables) -> DataFrame:
    """Each document's text, or its beginning, after a statement."""
    told = F.concat(pick(STATEMENTS, F.col("doc_id")), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.left("text", F.lit(9))))
    return t.documents.select("doc_id", rules.read_only_select(told).alias("ok"))


def _said(t: Tables, tails: list[str], number: Column) -> DataFrame:
    return transcripts.segments(t.conversations).withColumn("text", F.concat("text", pick(tails, number)))


def _said_sql(tails: list[str], number: str) -> str:
    return f"{s.SEGMENTS}, said AS (SELECT conv_id, seq, speaker, timestamp_ms, text || {s.listed(tails)}[{number} % {len(tails)} + 1] AS text FROM segments)"


@query("b20_compensation", f"WITH {_said_sql(PAY, 'seq')} SELECT conv_id, seq FROM said WHERE {s.matches('text', rules.PAY)}")
def compensation(t: Tables) -> DataFrame:
    return _said(t, PAY, F.col("seq")).where(rules.matches(F.col("text"), rules.PAY)).select("conv_id", "seq")


_WEIGHT = " + ".join("{1} * (CASE WHEN o{0} THEN 2 WHEN f{0} THEN 1 ELSE 0 END)".format(i, w) + f" * (m = '{m}')::INT" for i, (m, w, _) in enumerate(rules.MODE_CUES))


@query("i26_meeting_modes", f"""WITH {_said_sql(CUES, '(conv_id + seq // 3)')}, g AS (SELECT conv_id, {", ".join(f"bool_or({s.matches('text', p)} AND timestamp_ms <= first + 300000) AS o{i}, bool_or({s.matches('text', p)}) AS f{i}" for i, (_, _, p) in enumerate(rules.MODE_CUES))}
FROM (SELECT *, coalesce(min(timestamp_ms) FILTER (WHERE timestamp_ms > 0) OVER (PARTITION BY conv_id), 1e15) AS first FROM said) GROUP BY 1), h AS (SELECT *, {s.listed(TITLES)}[conv_id % {len(TITLES)} + 1] AS title FROM g),
k AS (SELECT conv_id, m, i, {_WEIGHT} + {" + ".join(f"CASE WHEN m = '{m}' AND {s.matches('title', p)} THEN {w} ELSE 0 END" for m, w, p in rules.TITLE_CUES)} AS score FROM h, (SELECT unnest({s.listed(rules.MODES)}) AS m, unnest(range({len(rules.MODES)})) AS i)),
z AS (SELECT conv_id, arg_min(m, (-score, i)) AS best, max(score) AS score, list_sort(list(score), 'DESC')[2] AS second FROM k GROUP BY 1)
SELECT conv_id, CASE WHEN score < 3 THEN 'general' ELSE best END AS mode, CASE WHEN score < 3 THEN 0.0 ELSE round(least(1.0, greatest(0.0, score / 12.0 * 0.6 + (score - second) / 8.0 * 0.4)), 2) END AS confidence FROM z""")
def meeting_modes(t: Tables) -> DataFrame:
    """Weighted cues, double in the opening five minutes, and title hints; one aggregate per conversation."""
    said = _said(t, CUES, F.col("conv_id") + F.floor(F.col("seq") / 3))
    starts = said.where("timestamp_ms > 0").groupBy("conv_id").agg(F.min("timestamp_ms").alias("first"))
    said = said.join(starts, "conv_id", "left").withColumn("opening", F.col("first").isNull() | (F.col("timestamp_ms") <= F.col("first") + 300_000))
    cues = []
    for i, (_, _, pattern) in enumerate(rules.MODE_CUES):
        hit = rules.matches(F.col("text"), pattern)
        cues += [F.bool_or(hit & F.col("opening")).alias(f"o{i}"), F.bool_or(hit).alias(f"f{i}")]
    seen = said.groupBy("conv_id").agg(*cues).withColumn("title", pick(TITLES, F.col("conv_id")))

    def score(mode: str) -> Column:
        total = sum((F.when(F.col(f"o{i}"), 2 * w).when(F.col(f"f{i}"), w).otherwise(0) for i, (m, w, _) in enumerate(rules.MODE_CUES) if m == mode), F.lit(0))
        return sum((F.when(rules.matches(F.col("title"), p), w).otherwise(0) for m, w, p in rules.TITLE_CUES if m == mode), total)

    ordered = F.array_sort(F.array(*[F.struct((-score(m)).alias("n"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(rules.MODES)]))
    out = seen.select("conv_id", ordered.alias("o")).select("conv_id", F.col("o")[0]["m"].alias("best"), (-F.col("o")[0]["n"]).alias("score"), (-F.col("o")[1]["n"]).alias("second"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 12 * 0.6 + (F.col("score") - F.col("second")) / 8 * 0.4))
    return out.select("conv_id", F.when(F.col("score") < 3, "general").otherwise(F.col("best")).alias("mode"), F.when(F.col("score") < 3, 0.0).otherwise(F.round(sure, 2)).alias("confidence"))


@query("i37_tones", f"""WITH {_said_sql(TALK, 'seq')}, g AS (SELECT conv_id, string_agg(text, ' ' ORDER BY seq) AS x, arg_max(speaker, seq) FILTER (WHERE speaker IN ('user', 'interviewer')) AS last FROM said WHERE timestamp_ms <= 180000 GROUP BY 1), n AS (SELECT conv_id, last, {", ".join(" + ".join(s.found("x", p) for p in ps) + f" AS {k}" for k, (_, _, ps) in rules.TONES.items())} FROM g)
SELECT conv_id, {", ".join(f"CASE WHEN {k} > {least} THEN round(least(1.0, {k} / {full}.0), 6) END AS {k}" for k, (least, full, _) in rules.TONES.items())}, CASE last WHEN 'interviewer' THEN 'responding_to_interviewer' WHEN 'user' THEN 'responding_to_user' ELSE 'general' END AS role FROM n""")
def tones(t: Tables) -> DataFrame:
    """Tone of what was said in the first three minutes and whom an answer would be for; counts are summed per segment."""
    said = _said(t, TALK, F.col("seq")).where("timestamp_ms <= 180000")
    # A phrase can't reach over two segments here: patterns are counted in each and summed.
    counts = [F.sum(sum((rules.found(F.col("text"), p) for p in ps), F.lit(0))).alias(k) for k, (_, _, ps) in rules.TONES.items()]
    heard = F.col("speaker").isin("user", "interviewer")
    got = said.groupBy("conv_id").agg(*counts, F.max_by(F.when(heard, F.col("speaker")), F.when(heard, F.col("seq"))).alias("last"))
    tone = [F.when(F.col(k) > least, F.round(F.least(F.lit(1.0), F.col(k) / full), 6)).alias(k) for k, (least, full, _) in rules.TONES.items()]
    return got.select("conv_id", *tone, F.when(F.col("last") == "interviewer", "responding_to_interviewer").when(F.col("last") == "user", "responding_to_user").otherwise("general").alias("role"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''))"


def _blend(a: str, b: str) -> str:
    both, union = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE greatest({both} / CAST({union} AS DOUBLE), CASE WHEN len({a}) > 0 THEN 0.9 * {both} / len({a}) ELSE 0.0 END) END"


_OWN = "len(list_filter({0}, lambda w: length(w) >= 3 AND NOT list_contains({1}, w))) > 0"


@query("i28_question_similarity", f"""WITH {s.SEGMENTS}, p AS (SELECT conv_id, seq, {_WORDS.format("early")} AS a, {_WORDS.format("text")} AS b FROM (SELECT conv_id, seq, text, CASE WHEN seq % 3 = 0 THEN left(text, 20) ELSE lag(text) OVER (PARTITION BY conv_id ORDER BY seq) END AS early FROM segments) WHERE early IS NOT NULL),
c AS (SELECT *, list_filter(a, lambda w: NOT list_contains({s.listed(rules.SIMILARITY_STOP)}, w)) AS ca, list_filter(b, lambda w: NOT list_contains({s.listed(rules.SIMILARITY_STOP)}, w)) AS cb FROM p), r AS (SELECT *, {_blend("a", "b")} AS raw, {_blend("ca", "cb")} AS content FROM c)
SELECT conv_id, seq, round(CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN raw WHEN {_OWN.format("ca", "cb")} AND {_OWN.format("cb", "ca")} THEN least(raw, content, 0.6) WHEN content < 0.6 THEN least(raw, content) ELSE raw END, 6) AS similarity FROM r""")
def question_similarity(t: Tables) -> DataFrame:
    """An interim form of each segment (its beginning, or the segment before it) against the segment."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("seq"))
    rows = transcripts.segments(t.conversations).withColumn("early", F.when(F.col("seq") % 3 == 0, F.left("text", F.lit(20))).otherwise(before)).where("early IS NOT NULL")
    return rows.select("conv_id", "seq", F.round(rules.question_similarity(F.col("early"), F.col("text")), 6).alias("similarity"))


@query("i30_text_hashes", r"""SELECT doc_id, 't_' || lower(printf('%X', (list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(left(n, 4000), ''), lambda c: CASE WHEN c = '' THEN NULL ELSE unicode(c)::HUGEINT END)), lambda h, c: coalesce((h * 31 + c) % 4294967296, h)) * 31 + length(n)) % 4294967296)) AS key FROM (SELECT doc_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS n FROM documents)""")
def text_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.hash_31(F.col("text")).alias("key"))


@query("i32_canonical_json", r"""SELECT c_custkey, '{"acct":' || CAST(c_nationkey AS VARCHAR) || ',"key":' || CAST(c_custkey AS VARCHAR) || ',"name":"' || c_name || '","segment":' || CASE WHEN c_nationkey = 3 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS json FROM customer""")
def canonical_json(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("acct"))
    return rows.select("c_custkey", rules.canonical_json(["name", "segment", "key", "acct"]).alias("json"))


@query("g4_deep_equality", r"""WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'True' WHEN 2 THEN event_type WHEN 3 THEN NULL WHEN 4 THEN '1.50' ELSE 'x' END AS a, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) || '.0' WHEN 1 THEN 'true' WHEN 2 THEN event_type ELSE '1.5' END AS b FROM events)
SELECT event_id, CASE WHEN regexp_matches(trim(a), '^-?\d+(\.\d+)?$') AND regexp_matches(trim(b), '^-?\d+(\.\d+)?$') THEN CAST(a AS DOUBLE) = CAST(b AS DOUBLE) WHEN lower(a) IN ('true', 'false') AND lower(b) IN ('true', 'false') THEN lower(a) = lower(b) ELSE a IS NOT DISTINCT FROM b END AS equal FROM p""")
def deep_equality(t: Tables) -> DataFrame:
    k = F.col("event_id")
    a = F.when(k % 6 == 0, F.col("user_id").cast("string")).when(k % 6 == 1, "True").when(k % 6 == 2, F.col("event_type")).when(k % 6 == 4, "1.50").when(k % 6 == 5, "x")
    b = F.when(k % 4 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".0"))).when(k % 4 == 1, "true").when(k % 4 == 2, F.col("event_type")).otherwise("1.5")
    return t.events.select("event_id", rules.values_equal(a, b).alias("equal"))


LESSON = ["", " A Hash Map is a structure that maps keys to values in constant time.", " Note that this will be tested.", " For example a queue.", " Backprop refers to the chain rule applied backwards through layers."]


@query("i35_lecture_points", rf"""WITH {_said_sql(LESSON, 'seq')} SELECT conv_id, seq, regexp_extract(text, {s.quoted(rules.DEFINITION)}, 1) AS term, regexp_extract(text, {s.quoted(rules.DEFINITION)}, 2) AS definition, {s.matches("text", rules.IMPORTANT)} AS important, {s.matches("text", rules.EXAMPLE)} AS example
FROM said WHERE {s.matches("text", rules.DEFINITION)} OR {s.matches("text", rules.IMPORTANT)} OR {s.matches("text", rules.EXAMPLE)}""")
def lecture_points(t: Tables) -> DataFrame:
    c = F.col("text")
    rows = _said(t, LESSON, F.col("seq")).withColumn("important", rules.matches(c, rules.IMPORTANT)).withColumn("example", rules.matches(c, rules.EXAMPLE)).withColumn("term", F.regexp_extract(c, rules.DEFINITION, 1))
    return rows.where((F.col("term") != "") | F.col("important") | F.col("example")).select("conv_id", "seq", "term", F.regexp_extract(c, rules.DEFINITION, 2).alias("definition"), "important", "example")


_TERM = r"[A-Z][a-z]{3,}"


@query("i29_course_concepts", f"""WITH c AS (SELECT source, term, count(*) AS mentions, min(doc_id) AS first FROM (SELECT source, doc_id, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM documents) GROUP BY 1, 2)
SELECT source AS course, term, mentions, 'What is ' || term || '?' AS front FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY mentions DESC, first, term) <= 12""")
def course_concepts(t: Tables) -> DataFrame:
    """The twelve most frequent capitalised terms of a course with their flashcards; the first document breaks ties."""
    terms = t.documents.select(F.col("source").alias("course"), "doc_id", F.explode(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))).alias("term"))
    counted = terms.groupBy("course", "term").agg(F.count("*").alias("mentions"), F.min("doc_id").alias("first"))
    best = top_per_group(counted, ["course"], 12, F.desc("mentions"), F.col("first"), F.col("term"))
    return best.select("course", "term", "mentions", F.concat(F.lit("What is "), "term", F.lit("?")).alias("front"))


@query("i4_speakers", f"""WITH {s.SEGMENTS} SELECT DISTINCT speaker, CASE lower(speaker) WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Assistant' ELSE speaker END AS name, CASE lower(speaker) WHEN 'user' THEN 'me' WHEN 'system' THEN 'speaker_1' ELSE lower(speaker) END AS speaker_id FROM segments""")
def speakers(t: Tables) -> DataFrame:
    c = F.col("speaker")
    return transcripts.segments(t.conversations).select("speaker").distinct().select("speaker", text.speaker_name(c).alias("name"), text.speaker_id(c).alias("speaker_id"))


_FILLER = s.listed(text.FILLERS + text.ACKNOWLEDGEMENTS)
EDGES = ["", " okay so"]


@query("i2_edge_fillers", rf"""WITH {_said_sql(EDGES, 'seq')}, w AS (SELECT conv_id, seq, list_filter(regexp_split_to_array('well ' || trim(text), '\s+'), lambda x: x <> '') AS w FROM said), i AS (SELECT *, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains({_FILLER}, regexp_replace(lower(w[k]), '[.,!?;:]', '', 'g'))) AS solid FROM w)
SELECT conv_id, seq, CASE WHEN len(solid) = 0 THEN '' ELSE array_to_string(list_slice(w, list_min(solid), list_max(solid)), ' ') END AS line FROM i""")
def edge_fillers(t: Tables) -> DataFrame:
    return _said(t, EDGES, F.col("seq")).select("conv_id", "seq", text.strip_edge_fillers(F.concat(F.lit("well "), F.trim("text"))).alias("line"))
