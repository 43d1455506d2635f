"""Queries over conversations, cut into line segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import rules, text
from loomline.operators import summaries, transcripts
from loomline.plans.sqltext import SEGMENTS, listed, quoted
from loomline.registry import Tables, query

_REPEAT = "r AS (SELECT conv_id, seq * 2 + i AS seq, speaker, text, timestamp_ms FROM segments, unnest(range(0, CASE WHEN seq % 7 = 0 THEN 2 ELSE 1 END)) AS u(i))"


def _segments(t: Tables) -> DataFrame:
    return transcripts.segments(t.conversations)


def _repeated(t: Tables) -> DataFrame:
    times = F.explode(F.sequence(F.lit(0), F.when(F.col("seq") % 7 == 0, 1).otherwise(0)))
    return _segments(t).select("conv_id", "seq", "speaker", "text", "timestamp_ms", times.alias("i")).withColumn("seq", F.col("seq") * 2 + F.col("i")).drop("i")


@query("e1_merge_turns", f"""WITH {SEGMENTS}, m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND timestamp_ms - lag(timestamp_ms) OVER w < 5000 THEN 0 ELSE 1 END AS new FROM segments WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY seq) AS island FROM m) SELECT conv_id, min(seq) AS seq, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY seq) AS text, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM g GROUP BY conv_id, island""")
def merge_turns(t: Tables) -> DataFrame:
    return transcripts.merge_turns(_segments(t))


@query("e2_drop_repeats", f"""WITH {SEGMENTS}, {_REPEAT} SELECT conv_id, seq, speaker FROM (SELECT *, lag(lower(speaker) || '::' || lower(text)) OVER (PARTITION BY conv_id ORDER BY seq) AS before FROM r) WHERE before IS NULL OR before <> lower(speaker) || '::' || lower(text)""")
def drop_repeats(t: Tables) -> DataFrame:
    return transcripts.drop_repeats(_repeated(t)).select("conv_id", "seq", "speaker")


@query("e3_long_gaps", f"""WITH {SEGMENTS}, g AS (SELECT conv_id, seq * 150000 * (1 + seq % 3) AS ts, seq FROM segments) SELECT conv_id, count(*) FILTER (WHERE ts - before > 420000) AS long_gaps FROM (SELECT *, lag(ts) OVER (PARTITION BY conv_id ORDER BY seq) AS before FROM g) GROUP BY conv_id""")
def long_gaps(t: Tables) -> DataFrame:
    rows = _segments(t).select("conv_id", "seq", (F.col("seq") * 150000 * (1 + F.col("seq") % 3)).alias("ts"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("conv_id").orderBy("seq"))
    return rows.withColumn("gap", gap).groupBy("conv_id").agg(F.count_if(F.coalesce(F.col("gap") > transcripts.LONG_GAP_MS, F.lit(False))).alias("long_gaps"))


@query("e7_latest_before", f"""WITH {SEGMENTS} SELECT conv_id, seq FROM (SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS n FROM segments WHERE timestamp_ms < 20000 AND contains(lower(text), 'th')) WHERE n <= 2""")
def latest_before(t: Tables) -> DataFrame:
    rows = _segments(t).where((F.col("timestamp_ms") < 20000) & F.lower("text").contains("th"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("seq")))).where("n <= 2").select("conv_id", "seq")


@query("e8_last_per_role", f"""WITH {SEGMENTS} SELECT conv_id, speaker, seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY seq DESC) AS n FROM segments) WHERE n <= 6""")
def last_per_role(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy(F.desc("seq")))
    return _segments(t).withColumn("n", place).where("n <= 6").select("conv_id", "speaker", "seq")


@query("e6_first_last", f"WITH {SEGMENTS} SELECT conv_id, arg_min(text, seq) AS first, arg_max(text, seq) AS last FROM segments GROUP BY conv_id")
def first_last(t: Tables) -> DataFrame:
    return _segments(t).groupBy("conv_id").agg(F.min_by("text", "seq").alias("first"), F.max_by("text", "seq").alias("last"))


@query("d13_speakers", f"""WITH {SEGMENTS} SELECT conv_id, CASE lower(speaker) WHEN 'user' THEN 'me' WHEN 'system' THEN 'speaker_1' ELSE lower(speaker) END AS speaker_id, count(*) AS segments FROM segments GROUP BY 1, 2""")
def speakers(t: Tables) -> DataFrame:
    return _segments(t).groupBy("conv_id", text.speaker_id(F.col("speaker")).alias("speaker_id")).agg(F.count("*").alias("segments"))


@query("b13_memory_eligible", "SELECT role, count(*) FILTER (WHERE role = 'user' OR (role <> 'assistant' AND turn % 4 < 1)) AS eligible FROM conversations GROUP BY role")
def memory_eligible(t: Tables) -> DataFrame:
    ok = (F.col("role") == "user") | ((F.col("role") != "assistant") & (F.col("turn") % 4 < 1))
    return t.conversations.groupBy("role").agg(F.count_if(ok).alias("eligible"))


_FLAGGED = "f AS (SELECT conv_id, seq, text || CASE WHEN seq % 11 = 0 THEN ' we agreed' ELSE '' END || CASE WHEN seq % 13 = 0 THEN ' need to follow up' ELSE '' END || CASE WHEN seq % 9 = 0 THEN '?' ELSE '' END AS t FROM segments)"


def _flagged(t: Tables) -> DataFrame:
    end = lambda k, s: F.when(F.col("seq") % k == 0, s).otherwise("")
    return _segments(t).select("conv_id", "seq", F.concat("text", end(11, " we agreed"), end(13, " need to follow up"), end(9, "?")).alias("t"))


@query("b14_flags", rf"""WITH {SEGMENTS}, {_FLAGGED} SELECT conv_id, seq, regexp_matches(t, '\?$') OR regexp_matches(t, '(?i)^({text.QUESTION_WORDS})\b') AS is_question, regexp_matches(t, '(?i)\b({text.DECISION_WORDS.replace("'", "''")})\b') AS is_decision,
regexp_matches(t, '(?i)\b({text.ACTION_WORDS})\b') OR regexp_matches(t, '(?i)\b({text.DEADLINE_WORDS})\b') AS is_action FROM f""")
def flags(t: Tables) -> DataFrame:
    c = F.col("t")
    return _flagged(t).select("conv_id", "seq", text.is_question(c).alias("is_question"), text.is_decision(c).alias("is_decision"), text.is_action(c).alias("is_action"))


@query("b17_interim_noise", rf"""WITH {SEGMENTS} SELECT conv_id, count(*) AS noise FROM segments WHERE length(regexp_replace(lower(text), '[\s.,!?;:]', '', 'g')) <= 1 OR regexp_replace(lower(text), '[\s.,!?;:]', '', 'g') IN {tuple(text.LINE_FILLERS)} GROUP BY conv_id""")
def interim_noise(t: Tables) -> DataFrame:
    return _segments(t).where(text.is_interim_noise(F.col("text"))).groupBy("conv_id").agg(F.count("*").alias("noise"))


@query("i18_dedupe_sources", f"WITH {SEGMENTS} SELECT lower(trim(text)) AS text, min(conv_id * 100000 + seq) AS first, count(*) AS n FROM segments GROUP BY 1")
def dedupe_sources(t: Tables) -> DataFrame:
    return _segments(t).groupBy(F.lower(F.trim("text")).alias("text")).agg(F.min(F.col("conv_id") * 100000 + F.col("seq")).alias("first"), F.count("*").alias("n"))


@query("i1_preprocess")
def preprocess(t: Tables) -> DataFrame:
    return transcripts.preprocess(_segments(t))


@query("i3_clean_lines")
def clean_lines(t: Tables) -> DataFrame:
    return _segments(t).select("conv_id", "seq", text.clean_line(F.col("text")).alias("line"), text.strip_edge_fillers(F.col("text")).alias("edges"))


@query("i5_quality")
def quality(t: Tables) -> DataFrame:
    return transcripts.quality(_repeated(t))


@query("i6_chunk_turns")
def chunk_turns(t: Tables) -> DataFrame:
    return transcripts.chunk_turns(transcripts.preprocess(_segments(t)))


@query("i7_chunk_long")
def chunk_long(t: Tables) -> DataFrame:
    return transcripts.chunk_long(_segments(t), most=300, overlap=40, short=150)


@query("i20_merge_similar")
def merge_similar(t: Tables) -> DataFrame:
    return summaries.merge_similar(_segments(t))


@query("i21_sections")
def summary_sections(t: Tables) -> DataFrame:
    """Questions, decisions and actions of conversations as findings of three declared sections; those of no section stay out."""
    c = F.col("t")
    kind = F.array_compact(F.array(F.when(text.is_question(c), F.lit("Open questions")), F.when(text.is_decision(c), F.lit(" decisions ")), F.when(text.is_action(c), F.lit("Actions")), F.lit("Other")))
    return summaries.sections(_flagged(t).select("conv_id", "seq", F.explode(kind).alias("section"), F.col("t").alias("text")), ["Decisions", "Actions", "Open Questions"], 40)


@query("i21_timeline", rf"""WITH {SEGMENTS}, {_FLAGGED}, i AS (SELECT conv_id, seq, 0 AS o, 'topic_shift' AS kind, left(text, 80) AS title, timestamp_ms AS at_ms FROM segments WHERE seq % 10 = 0
UNION ALL SELECT f.conv_id, f.seq, 1, 'decision', t, timestamp_ms FROM f JOIN segments USING (conv_id, seq) WHERE regexp_matches(t, '(?i)\b({text.DECISION_WORDS.replace("'", "''")})\b')
UNION ALL SELECT f.conv_id, f.seq, 2, 'action_item', t, timestamp_ms FROM f JOIN segments USING (conv_id, seq) WHERE regexp_matches(t, '(?i)\b({text.ACTION_WORDS})\b') OR regexp_matches(t, '(?i)\b({text.DEADLINE_WORDS})\b'))
SELECT conv_id, CAST(row_number() OVER w - 1 AS INT) AS place, kind, title, at_ms FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY at_ms, o, seq) QUALIFY row_number() OVER w <= 20""")
def summary_timeline(t: Tables) -> DataFrame:
    """The first line of every ten opens a topic; decisions and actions follow it in time."""
    rows = _flagged(t).join(_segments(t).select("conv_id", "seq", F.col("timestamp_ms").alias("at_ms")), ["conv_id", "seq"])
    item = lambda kept, order, kind: kept.select("conv_id", "seq", F.lit(order).alias("order"), F.lit(kind).alias("kind"), F.col("t").alias("title"), "at_ms")
    briefs = _segments(t).where("seq % 10 = 0").select("conv_id", "seq", F.lit(0).alias("order"), F.lit("topic_shift").alias("kind"), F.left("text", F.lit(80)).alias("title"), F.col("timestamp_ms").alias("at_ms"))
    found = briefs.unionByName(item(rows.where(text.is_decision(F.col("t"))), 1, "decision")).unionByName(item(rows.where(text.is_action(F.col("t"))), 2, "action_item"))
    return summaries.timeline(found)


ACTIONS = ["", " We need to call Bob by Friday.", " Alice will send the report", " todo: review the plan before Monday 3pm!", " I must finish.", " share it with them", " and nothing more on Tuesday"]
_SAID = f"said AS (SELECT conv_id, seq, trim(text || {listed(ACTIONS)}[seq % {len(ACTIONS)} + 1]) AS t FROM segments)"
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN regexp_extract(t, {quoted(p)}, {{0}})" for p in rules.ACTION_LINES) + " ELSE '' END"


@query("i19_action_items", rf"""WITH {SEGMENTS}, {_SAID}, a AS (SELECT conv_id, seq, trim(regexp_replace(regexp_replace(regexp_replace({_FIRST.format(1)}, {quoted(rules.ACTION_HEAD)}, ''), '\s+', ' ', 'g'), '[.!?]+$', '')) AS action, regexp_extract(t, {quoted(rules.ACTION_OWNER)}, 1) AS name, trim(coalesce(nullif({_FIRST.format(2)}, ''), nullif(regexp_extract(t, {quoted(rules.ACTION_DEADLINE)}, 1), ''))) AS deadline FROM said),
f AS (SELECT * FROM a WHERE action <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(action) ORDER BY seq) = 1)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS INT) AS place, seq, action, CASE WHEN name = '' THEN NULL WHEN lower(name) = 'i' THEN 'Me' ELSE upper(name[1]) || name[2:] END AS owner, deadline FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq) <= {rules.ACTIONS_KEPT}""")
def action_items(t: Tables) -> DataFrame:
    """What is to be done, by whom and until when: each action once, the first eight of a conversation."""
    said = F.concat("text", F.get(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("seq") % len(ACTIONS)).cast("int")))
    found = _segments(t).select("conv_id", "seq", rules.action_item(said).alias("a")).where("a IS NOT NULL").select("conv_id", "seq", F.col("a.text").alias("action"), "a.owner", "a.deadline")
    first = found.groupBy("conv_id", F.lower("action").alias("key")).agg(F.min_by(F.struct("seq", "action", "owner", "deadline"), "seq").alias("r")).select("conv_id", "r.*")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1).where(F.col("place") < rules.ACTIONS_KEPT)
    return placed.select("conv_id", "place", "seq", "action", "owner", "deadline")


@query("h37_intent", rf"""WITH {SEGMENTS} SELECT conv_id, seq, CASE WHEN regexp_matches(lower(text), '\b(decide|decision|agreed|conclusion|settled|determined|resolved)\b') THEN 'decision_recall' WHEN regexp_matches(lower(text), 'who said|what did (\w+|he|she|they) say') THEN 'speaker_lookup'
WHEN regexp_matches(lower(text), '\b(action|task|todo|to-do|follow[- ]?up|next step|assigned|deadline)\b') THEN 'action_items' WHEN regexp_matches(lower(text), '\b(summar|overview|recap|highlights?|key points?)\b|^(summarize|recap|give me a summary)') THEN 'summary' ELSE 'open_question' END AS intent FROM segments""")
def intent(t: Tables) -> DataFrame:
    c = F.lower("text")
    found = F.when(c.rlike(text.word("decide|decision|agreed|conclusion|settled|determined|resolved")), "decision_recall").when(c.rlike(r"who said|what did (\w+|he|she|they) say"), "speaker_lookup")
    found = found.when(c.rlike(text.word("action|task|todo|to-do|follow[- ]?up|next step|assigned|deadline")), "action_items")
    found = found.when(c.rlike(text.word("summar|overview|recap|highlights?|key points?")) | c.rlike("^(summarize|recap|give me a summary)"), "summary").otherwise("open_question")
    return _segments(t).select("conv_id", "seq", found.alias("intent"))


@query("l3_sliding_context", f"WITH {SEGMENTS} SELECT conv_id, seq, count(*) OVER (PARTITION BY conv_id ORDER BY timestamp_ms RANGE BETWEEN 180000 PRECEDING AND CURRENT ROW) AS context FROM segments")
def sliding_context(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("timestamp_ms").rangeBetween(-180_000, 0)
    return _segments(t).select("conv_id", "seq", F.count("*").over(w).alias("context"))
