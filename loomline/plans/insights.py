"""Insights of meetings (questions, decisions, actions, risks, entities), their records, grounding, page text and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import rules, text
from loomline.operators.ranking import top_per_group
from loomline.plans import sqltext as s
from loomline.plans.questions import _said, _said_sql
from loomline.registry import Tables, query

# Patterns and words that results depend on.
QUESTION = r"(?i)\?\s*$|^(what|who|when|where|why|how|can|could|would|should|is|are|do|does|did)\b"
DECISION = r"(?i)\b(decided|agreed|confirmed|approved|let'?s go with|we'?ll do|going with|we will|final decision)\b|^\s*decision\b\s*[:\-]|\b(launch(?:es|ing)?|ship(?:s|ping)?|go(?:ing)? live)\b.*\b(next|on|by)\b"
ACTION = r"(?i)\b(will|going to|need to|have to|must|action item|to[- ]?do|follow[- ]?up)\b|^\s*(action|todo|to[- ]?do|task)\b\s*[:\-]|\b(owns?|owner|responsible for|on the hook for|takes? (?:on|over)|assigned to)\b"
RISK = r"(?i)^\s*(risk|blocker|concern|issue)\b\s*[:\-]|\b(risk|blocker|blocked by|concern(?:ed)?|may (?:exceed|slip|overrun|miss)|might (?:exceed|slip|fail)|over budget|behind schedule|won'?t (?:make|hit))\b"
ENTITY_STOP = "the this that these those have has had tell what when where which who why how and but for are was were can could would should will did does your you our they their with about into from okay yes sure right well let give sorry thanks hello maybe".split()
TAILS = ["", " we agreed on it", " I need to call Bob", " there is a risk here", " is it done?", " Acme Labs ships next week"]
_KINDS = {"questions": QUESTION, "decisions": DECISION, "actions": ACTION, "risks": RISK}
_E = f"WITH {_said_sql(TAILS, 'seq')}, e AS (SELECT *, " + ", ".join(f"{s.matches('text', p)} AS {k}" for k, p in _KINDS.items()) + " FROM said WHERE speaker <> 'assistant')"


def _eligible(t: Tables) -> DataFrame:
    rows = _said(t, TAILS, F.col("seq")).where("speaker <> 'assistant'")
    return rows.select("*", *[rules.matches(F.col("text"), p).alias(k) for k, p in _KINDS.items()])


def _lines(kind: str) -> Column:
    """Different lines of a kind, twenty at most; a risk is neither a decision nor an action, short lines ask and do nothing."""
    ok = F.col(kind)
    if kind in ("decisions", "actions"):
        ok = ok & ~F.col("risks")
    if kind in ("questions", "actions"):
        ok = ok & (F.length("text") > 8)
    return F.least(F.lit(20), F.count_distinct(F.when(ok, F.col("text")))).alias(kind)


_COUNTS = ", ".join(f"least(20, count(DISTINCT CASE WHEN {k}{' AND NOT risks' if k in ('decisions', 'actions') else ''}{' AND length(text) > 8' if k in ('questions', 'actions') else ''} THEN text END)) AS {k}" for k in _KINDS)


@query("i16_insights", f"{_E} SELECT conv_id, {_COUNTS} FROM e GROUP BY conv_id")
def insights(t: Tables) -> DataFrame:
    return _eligible(t).groupBy("conv_id").agg(*[_lines(k) for k in _KINDS])


@query("i17_meeting_records", f"{_E}, n AS (SELECT conv_id, count(*) AS turns, count(DISTINCT speaker) AS participants, {_COUNTS} FROM e GROUP BY conv_id) SELECT conv_id, participants, turns, round(least(1.0, least(turns / 20.0, 0.3) + CASE WHEN questions > 0 THEN 0.3 ELSE 0 END + CASE WHEN decisions > 0 THEN 0.2 ELSE 0 END + CASE WHEN actions > 0 THEN 0.2 ELSE 0 END + CASE WHEN risks > 0 THEN 0.1 ELSE 0 END), 6) AS quality FROM n")
def meeting_records(t: Tables) -> DataFrame:
    got = _eligible(t).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("speaker").alias("participants"), *[_lines(k) for k in _KINDS])
    has = lambda k, v: F.when(F.col(k) > 0, v).otherwise(0.0)
    quality = F.least(F.lit(1.0), F.least(F.col("turns") / 20, F.lit(0.3)) + has("questions", 0.3) + has("decisions", 0.2) + has("actions", 0.2) + has("risks", 0.1))
    return got.select("conv_id", "participants", "turns", F.round(quality, 6).alias("quality"))


_NAME = "[A-Z][a-z0-9]{2,}"


@query("i22_entities", f"""WITH {_said_sql(TAILS, 'seq')}, x AS (SELECT conv_id, seq, regexp_extract_all(text, '{_NAME}') AS w FROM said), k AS (SELECT conv_id, w[i] AS name, seq * 10000 + i AS spot FROM x, unnest(range(1, len(w) + 1)) AS u(i) WHERE lower(w[i]) NOT IN ({", ".join(map(s.quoted, ENTITY_STOP))})),
f AS (SELECT conv_id, lower(name) AS slug, min(spot) AS spot, arg_min(name, spot) AS name FROM k GROUP BY 1, 2) SELECT conv_id, name FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY spot) <= 24""")
def entities(t: Tables) -> DataFrame:
    """Names in the order in which they first stand, each once in any case, 24 at most."""
    rows = _said(t, TAILS, F.col("seq")).select("conv_id", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(_NAME), F.lit(0))).alias("i", "name"))
    rows = rows.where(~F.lower("name").isin(ENTITY_STOP)).withColumn("at", F.col("seq") * 10000 + F.col("i") + 1)
    first = rows.groupBy("conv_id", F.lower("name").alias("slug")).agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"))
    return top_per_group(first, ["conv_id"], 24, F.col("at")).select("conv_id", "name")


_CARD = "left(text, 200) || CASE doc_id % 5 WHEN 0 THEN ' invented clause wholly unsupported' WHEN 1 THEN '. Qqxz vvkq zzwq xxjq yyqz.' ELSE '' END"
_SHARE = "len(list_filter(list_distinct(w), lambda x: contains(source, x))) / CAST(len(list_distinct(w)) AS DOUBLE)"


@query("i24_grounding", rf"""WITH c AS (SELECT doc_id, lower(text) AS source, {_CARD} AS card FROM documents), g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE {_SHARE} END AS score FROM (SELECT doc_id, source, {s.tokens("card")} AS w FROM c)),
e AS (SELECT doc_id, source, unnest(string_split(regexp_replace(card, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM c), m AS (SELECT doc_id, min({_SHARE}) AS least FROM (SELECT doc_id, source, {s.tokens("sentence")} AS w FROM e) WHERE len(w) >= {rules.SENTENCE_WORDS} GROUP BY 1)
SELECT doc_id, round(score, 6) AS score, round(least, 6) AS least, CASE WHEN score < {rules.CARD_LEAST} OR coalesce(least, 1) < {rules.SENTENCE_LEAST} THEN 'rejected' WHEN score < {rules.CARD_SURE} THEN 'downgraded' ELSE 'accepted' END AS verdict FROM g LEFT JOIN m USING (doc_id)""")
def grounding(t: Tables) -> DataFrame:
    """Share of a card's words that its source holds, whole and of its weakest sentence; too little of either rejects it."""
    tail = F.when(F.col("doc_id") % 5 == 0, " invented clause wholly unsupported").when(F.col("doc_id") % 5 == 1, ". Qqxz vvkq zzwq xxjq yyqz.").otherwise("")
    body = F.concat(F.left("text", F.lit(200)), tail)
    rows = t.documents.select("doc_id", rules.grounding(body, F.col("text"), text.tokens).alias("score"), rules.weakest_sentence(body, F.col("text"), text.tokens).alias("least"))
    bad = (F.col("score") < rules.CARD_LEAST) | (F.coalesce("least", F.lit(1.0)) < rules.SENTENCE_LEAST)
    return rows.select("doc_id", F.round("score", 6).alias("score"), F.round("least", 6).alias("least"), F.when(bad, "rejected").when(F.col("score") < rules.CARD_SURE, "downgraded").otherwise("accepted").alias("verdict"))


_MADE = "html || CASE WHEN page_id % 4 = 0 THEN '<h2>Part  <b>one</b></h2><h2>Part one</h2><h3>Detail</h3>' ELSE '' END"
_BARE = r"trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@query("k2_heading_outline", rf"""WITH h AS (SELECT page_id, list_filter(list_transform(regexp_extract_all({_MADE}, '(?is)<h[1-3]\b[^>]*>.*?</h[1-3]>'), lambda x: CASE WHEN {_BARE} = '' THEN '' ELSE CASE x[3] WHEN '1' THEN '' WHEN '2' THEN '  ' ELSE '    ' END || {_BARE} END), lambda x: x <> '') AS h FROM pages)
SELECT page_id, coalesce(array_to_string(list_filter(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN i = 1 OR h[i] <> h[i - 1] THEN h[i] END), lambda x: x IS NOT NULL), chr(10)), '') AS outline FROM h""")
def heading_outline(t: Tables) -> DataFrame:
    """Headings of three levels in page order, indented, repeats of the one before left out; references stay as written."""
    html = F.concat("html", F.when(F.col("page_id") % 4 == 0, "<h2>Part  <b>one</b></h2><h2>Part one</h2><h3>Detail</h3>").otherwise(""))
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    depth = lambda x: F.when(F.substring(x, 3, 1) == "1", "").when(F.substring(x, 3, 1) == "2", "  ").otherwise("    ")
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3]\b[^>]*>.*?</h[1-3]>"), F.lit(0))
    rows = t.pages.select("page_id", F.filter(F.transform(found, lambda x: F.when(bare(x) == "", "").otherwise(F.concat(depth(x), bare(x)))), lambda x: x != "").alias("h"))
    kept = F.filter("h", lambda x, i: (i == 0) | (x != F.get("h", i - 1)))
    return rows.select("page_id", F.array_join(kept, "\n").alias("outline"))


@query("k1_stripped_text", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<(noscript|template)\b.*?</(noscript|template)>', ' ', 'g') AS html FROM pages""".replace("SELECT page_id, regexp", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp", 1).replace(" AS html FROM", r", '<[^>]*>', '', 'g'), '[ \t\f\v]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10)) AS text FROM"))
def stripped_text(t: Tables) -> DataFrame:
    """Text without scripts, styles and templates; runs of blanks collapse, paragraph breaks stay."""
    out = F.regexp_replace("html", r"(?is)<(script|style|noscript|template)\b.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]*>", ""), r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n")
    return t.pages.select("page_id", F.btrim(out, F.lit(" \n")).alias("text"))
