"""Sources and sinks, filters, post-filtered top k, gates and scores over evidence, and insights of meetings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import rules, scores, text
from loomline.operators import extraction, graph, transcripts
from loomline.operators import retrieval as r
from loomline.operators.ranking import rank_in_groups, top_per_group
from loomline.plans import retrieval as plans
from loomline.plans import sqltext as s
from loomline.plans.questions import pick
from loomline.registry import Tables, query
from loomline.sources import files
from loomline.streaming import folds, live
from loomline.streaming.stateful import fold_batch

_TOKENS = s.tokens("text")


@query("a3_index_scan", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) WHERE term IN ('reason', 'thing', 'with') GROUP BY 1, 2")
def index_scan(t: Tables) -> DataFrame:
    """Postings of a few terms, from the stored index."""
    return plans._index(t).postings(["reason", "thing", "with"]).select("term", F.col("key").alias("doc_id"), "tf")


@query("a4_vector_scan", f"WITH {plans._SEM} SELECT doc_id AS vec_id, round(1 - semantic, 6) AS distance FROM sem ORDER BY 2, 1 LIMIT 15")
def vector_scan(t: Tables) -> DataFrame:
    hits = plans._vectors(t).top(plans._own_vector(t), 15, leave=F.col("vec_id") == plans.VECTOR_ID)
    return hits.select("vec_id", F.round(1 - F.col("similarity"), 6).alias("distance"))


@query("a5_marked_documents", r"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'extension' WHEN doc_id % 6 = 4 THEN 'binary' END AS refused, CASE WHEN doc_id % 6 = 5 THEN regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', chr(65533), 'g') ELSE text END AS text FROM documents)
SELECT doc_id, refused, CASE WHEN refused IS NULL THEN length(text) END AS chars, CASE WHEN refused IS NULL THEN md5(text) END AS digest FROM f""")
def marked_documents(t: Tables) -> DataFrame:
    """Each document as a file's bytes: UTF-16 of either order, UTF-8 with and without a mark, with a zero byte, as DOCX, as PDF."""
    n, c = F.col("doc_id") % 6, F.col("text")
    bytes_of = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(c, charset))
    content = F.when(n == 0, bytes_of("FFFE", "UTF-16LE")).when(n == 1, bytes_of("FEFF", "UTF-16BE")).when(n == 2, bytes_of("EFBBBF", "UTF-8")).when(n == 3, F.encode(c, "UTF-8")).otherwise(bytes_of("2000", "UTF-8"))
    flat = t.documents.where(n < 5).select(F.col("doc_id").alias("id"), content.alias("content"))
    whole = flat.unionByName(files.boxed(t.documents.where(n == 5).select(F.col("doc_id").alias("id"), "text")))
    ending = F.when(F.col("id") % 7 == 0, ".pdf").when(F.col("id") % 6 == 5, ".docx").otherwise(".txt")
    read = files.documents(whole.select(F.concat(F.lit("store/"), F.col("id").cast("string"), ending).alias("path"), F.length("content").cast("long").alias("length"), "content"))
    return read.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), "refused", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("a6_document_source", r"SELECT '.txt' AS extension, count(*) AS lines, sum(length(text)) AS chars, count(*) FILTER (WHERE text = '') AS empty FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)")
def document_source(t: Tables) -> DataFrame:
    """Texts exported as .txt files, read back as documents; byte order marks and refusals are tested on files of their own."""
    folder = live.shared_folder(t.spark)
    files.export_lines(t.documents.select(F.explode(F.split("text", "\n")).alias("value")), t.documents.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0, folder)
    read = files.read_documents(t.spark, folder).where("refused IS NULL").select("extension", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return read.groupBy("extension").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.count_if(F.col("line") == "").alias("empty"))


@query("a10_bulk_insert", "SELECT conv_id, turn, md5(text) AS digest FROM conversations UNION ALL SELECT conv_id + 1000000, turn, md5(text) FROM conversations WHERE role = 'user'")
def bulk_insert(t: Tables) -> DataFrame:
    folder, rows = live.shared_folder(t.spark), t.conversations.select("conv_id", "turn", F.md5("text").alias("digest"), "role")
    files.append_rows(rows.drop("role"), folder)
    files.append_rows(rows.where("role = 'user'").withColumn("conv_id", F.col("conv_id") + 1000000).drop("role"), folder)
    return t.spark.read.parquet(folder)


@query("a19_json_lines", "SELECT event_id, event_type, value FROM events")
def json_lines(t: Tables) -> DataFrame:
    folder, rows = live.shared_folder(t.spark), t.events.select("event_id", "event_type", "value")
    files.append_json_lines(rows, folder)
    return t.spark.read.schema(rows.schema).json(folder)


@query("a20_markdown_export", r"SELECT source AS pack, CAST(sum(5 + len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM documents GROUP BY 1")
def markdown_export(t: Tables) -> DataFrame:
    folder = live.shared_folder(t.spark)
    made = files.card_markdown(F.concat(F.lit("Card "), F.col("doc_id").cast("string")), {"Language": F.col("lang")}, F.concat(F.lit("\n"), F.col("text")))
    files.export_markdown(t.documents.select(F.col("source").alias("pack"), made.alias("markdown")), folder)
    body = ~F.col("value").rlike(r"^(# Card \d+|- \*\*Language\*\*: .*)$")
    return t.spark.read.text(folder).groupBy("pack").agg(F.count("*").alias("lines"), F.sum(F.when(body, F.char_length("value")).otherwise(0)).alias("chars"))


@query("b1_renamed", "SELECT l_orderkey AS orderKey, l_linenumber AS lineNumber, l_extendedprice AS extendedPrice FROM lineitem WHERE l_linenumber = 1")
def renamed(t: Tables) -> DataFrame:
    names = {"l_orderkey": "orderKey", "l_linenumber": "lineNumber", "l_extendedprice": "extendedPrice"}
    return t.lineitem.where("l_linenumber = 1").select(*[F.col(old).alias(new) for old, new in names.items()])


def passes(filters: dict) -> Column:
    """All given facets hold; absent ones don't count. A row without a date passes neither bound."""
    out = F.lit(True)
    for name, want in filters.items():
        if want is None or want == "" or want is False:
            continue
        if name == "date_from":
            out = out & (F.coalesce("date", F.lit(0)) >= want)
        elif name == "date_to":
            out = out & F.coalesce(F.col("date") <= want, F.lit(False))
        elif name in ("title", "company", "participant"):
            out = out & F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(want.lower()))
        elif name == "course":
            out = out & (F.lower(F.coalesce(name, F.lit(""))) == want.lower())
        elif want is True:
            out = out & F.coalesce(F.col(name) == "true", F.lit(False))
        else:
            out = out & F.coalesce(F.col(name) == want, F.lit(False))
    return out


@query("b11_facets", """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN doc_id END AS date, lang AS mode, source, left(text, 30) AS title FROM documents)
SELECT doc_id, 'dates' AS filter FROM c WHERE date >= 20 AND date <= 900 UNION ALL SELECT doc_id, 'facets' FROM c WHERE mode = 'en' AND contains(lower(title), 'th') UNION ALL SELECT doc_id, 'course' FROM c WHERE source = 'src3' UNION ALL SELECT doc_id, 'none' FROM c""")
def facets(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("date"), F.col("lang").alias("mode"), F.col("source").alias("course"), F.left("text", F.lit(30)).alias("title"))
    wanted = {"dates": {"date_from": 20, "date_to": 900, "mode": None}, "facets": {"mode": "en", "title": "TH"}, "course": {"course": "SRC3"}, "none": {"title": "", "has_actions": False}}
    hits = F.filter(F.array(*[F.when(passes(f), name) for name, f in wanted.items()]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(hits).alias("filter"))


def in_scope(user: int, org: int | None = None) -> Column:
    """Rows of one user and, if given, one organisation; rows without an organisation then don't pass."""
    own = F.col("user_id") == user
    return own if org is None else own & F.coalesce(F.col("org_id") == org, F.lit(False))


@query("b12_tenant_scope", "WITH c AS (SELECT conv_id, turn, conv_id % 5 AS user_id, CASE WHEN turn % 3 <> 0 THEN conv_id % 2 END AS org_id FROM conversations) SELECT conv_id, turn, user_id = 2 AND coalesce(org_id = 1, false) AS own FROM c WHERE user_id = 2")
def tenant_scope(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", (F.col("conv_id") % 5).alias("user_id"), F.when(F.col("turn") % 3 != 0, F.col("conv_id") % 2).alias("org_id"))
    return rows.where(in_scope(2)).select("conv_id", "turn", in_scope(2, 1).alias("own"))


@query("c8_hydrated_hits", f"WITH {plans._SEM}, k AS (SELECT doc_id, row_number() OVER (ORDER BY round(semantic, 6) DESC, doc_id) AS rank FROM sem QUALIFY rank <= 40) SELECT rank, doc_id, lang, n_chars FROM k JOIN documents USING (doc_id)")
def hydrated_hits(t: Tables) -> DataFrame:
    """The hits with their rows, in the order of their ranks; forty rows are joined to the table."""
    hits = r.rank_each(plans._six(plans._semantic(t), "semantic"), 40, F.desc("semantic"), F.col("doc_id")).select("doc_id", F.col("rank").cast("long"))
    return t.documents.select("doc_id", "lang", "n_chars").join(F.broadcast(hits), "doc_id").select("rank", "doc_id", "lang", "n_chars").orderBy("rank")


@query("e4_rank_in_source", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def rank_in_source(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars")
    return rank_in_groups(rows, ["source"], -F.floor(F.col("n_chars") / 64), F.desc("n_chars"), F.col("doc_id")).select("doc_id", F.col("rank").cast("long"))


@query("f3_fused_order", f"WITH {plans._LEX}, {plans._SEM}, {plans._RANKED}, f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf, count(*) AS sources FROM ranked GROUP BY doc_id) SELECT doc_id, row_number() OVER (ORDER BY rrf DESC, sources DESC, doc_id) AS place FROM f QUALIFY place <= 12")
def fused_order(t: Tables) -> DataFrame:
    best = r.rank_each(plans._six(r.rrf(plans._ranked(t), "doc_id"), "rrf"), 12, F.desc("rrf"), F.desc("sources"), F.col("doc_id"))
    return best.select("doc_id", F.col("rank").cast("long").alias("place"))


def _near(scope: str, limit: int) -> str:
    return f"WITH {plans._SEM} SELECT doc_id, round(semantic, 6) AS similarity FROM sem JOIN documents USING (doc_id) WHERE {scope} ORDER BY 2 DESC, 1 LIMIT {limit}"


def filtered_topk(t: Tables, scope: Column, limit: int) -> DataFrame:
    """The nearest rows in scope. The filter comes before the cut, so k rows come back if k exist."""
    rows = plans._six(plans._semantic(t).withColumnRenamed("semantic", "similarity"), "similarity").join(t.documents.where(scope).select("doc_id"), "doc_id")
    return r.top(rows, search_limit(limit), F.desc("similarity"), F.col("doc_id"))


def search_limit(limit: int | None) -> int:
    """A limit of 1 to 200; 20 where none is given."""
    value = 20 if limit is None else limit
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= 200:
        raise ValueError("a search limit must be an integer from 1 to 200")
    return value


@query("f4_filtered_topk", _near("lang = 'de'", 10))
def f4_filtered_topk(t: Tables) -> DataFrame:
    return filtered_topk(t, F.col("lang") == "de", 10)


@query("f5_post_filtered", f"WITH {plans._SEM}, h AS (SELECT doc_id, round(semantic, 6) AS similarity FROM sem JOIN documents USING (doc_id) WHERE source IN ('src1', 'src3', 'src7') AND n_chars > 50 ORDER BY 2 DESC, 1 LIMIT 10) SELECT *, 10 - (SELECT count(*) FROM h) AS shortfall FROM h")
def f5_post_filtered(t: Tables) -> DataFrame:
    """The nearest rows that pass the filter, of all rows; ``shortfall`` tells how many of the limit don't exist."""
    limit = 10
    kept = filtered_topk(t, F.col("source").isin("src1", "src3", "src7") & (F.col("n_chars") > 50), limit)
    return kept.withColumn("shortfall", F.lit(limit) - F.count("*").over(Window.partitionBy(F.lit(1))))  # ``limit`` rows


@query("f6_limits", "SELECT event_id, CASE WHEN value IS NULL THEN 20 WHEN value = floor(value) AND value BETWEEN 1 AND 200 THEN CAST(value AS BIGINT) END AS n FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN floor(value * 3) ELSE value END END AS value FROM events)")
def limits(t: Tables) -> DataFrame:
    value = F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") * 3).cast("double")).otherwise(F.col("value")))
    rows = t.events.select("event_id", value.alias("value"))
    return rows.select("event_id", F.when(F.col("value").isNull(), 20).when((F.col("value") == F.floor("value")) & F.col("value").between(1, 200), F.col("value").cast("long")).alias("n"))


@query("f7_chronological", f"WITH {plans._SEM}, k AS (SELECT doc_id FROM sem ORDER BY round(semantic, 6) DESC, doc_id LIMIT 12) SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM k")
def chronological(t: Tables) -> DataFrame:
    best = r.top(plans._six(plans._semantic(t), "semantic"), 12, F.desc("semantic"), F.col("doc_id"))
    return r.rank_each(best, 12, F.col("doc_id")).select("doc_id", F.col("rank").cast("long").alias("place"))


FUZZY = ["thing", "reasen", "witth", "from", "there"]
_FUZZY = f"""f AS (SELECT doc_id, text, list_distinct({_TOKENS}) AS w, {s.listed(FUZZY)} AS q FROM documents), z AS (SELECT doc_id, text, CASE WHEN len(w) = 0 THEN 0.0 ELSE (len(list_filter(w, lambda x: list_contains(q, x))) + 0.5 * len(list_filter(w, lambda x: NOT list_contains(q, x) AND length(x) >= 4 AND len(list_filter(q, lambda y: length(y) >= 4 AND abs(length(x) - length(y)) <= 1 AND levenshtein(x, y) = 1)) > 0))) / sqrt(len(q) * CAST(len(w) AS DOUBLE)) END AS lexical FROM f)"""


def fuzzy_lexical(w: Column, terms: list[str]) -> Column:
    """Set cosine of different words ``w`` in which words of four letters or more, one edit from a term, count half."""
    q = F.array(*[F.lit(x) for x in terms])
    long = [x for x in terms if len(x) >= 4]
    near = lambda x: reduce(or_, ((F.length(x).between(max(4, len(y) - 1), len(y) + 1)) & (F.levenshtein(x, F.lit(y), 1) == 1) for y in long))
    rest = F.filter(w, lambda x: near(x) & ~x.isin(terms))
    return F.when(F.size(w) == 0, 0.0).otherwise((F.size(F.array_intersect(w, q)) + 0.5 * F.size(rest)) / F.sqrt(len(terms) * F.greatest(F.size(w), F.lit(1)).cast("double")))


@query("h8_fuzzy_lexical", f"WITH {_FUZZY} SELECT doc_id, round(lexical, 6) AS score FROM z WHERE lexical > 0")
def h8_fuzzy_lexical(t: Tables) -> DataFrame:
    return r.with_words(t.documents, "doc_id").select("doc_id", r.once(F.round(fuzzy_lexical(F.col("w"), FUZZY), 6)).alias("score")).where("score > 0")


ENTITIES = ["the", "there", "c++", "edth"]


def entity_share(body: Column, entities: list[str]) -> Column:
    """Share of the entities that a text names, as whole words where they are words."""
    lower, hits = F.lower(body), F.lit(0)
    for e in entities:
        plain = all(c.isascii() and (c.isalnum() or c == "-") for c in e)
        hits = hits + (lower.rlike(f"(^|[^a-z0-9]){e}([^a-z0-9]|$)") if plain else lower.contains(e)).cast("int")
    return hits / float(len(entities))


@query("h9_entity_fusion", f"WITH {_FUZZY} SELECT doc_id, round(0.55 * lexical + 0.45 * (" + " + ".join(f"regexp_matches(lower(text), '(^|[^a-z0-9]){e}([^a-z0-9]|$)')::INT" if e.isalpha() else f"contains(lower(text), '{e}')::INT" for e in ENTITIES) + f") / {float(len(ENTITIES))}, 6) AS score FROM z")
def entity_fusion(t: Tables) -> DataFrame:
    score = 0.55 * fuzzy_lexical(F.col("w"), FUZZY) + 0.45 * entity_share(F.col("text"), ENTITIES)
    return r.with_words(t.documents, "doc_id", "text").select("doc_id", F.round(score, 6).alias("score"))


@query("h22_rerank", f"""WITH {plans._LEX}, {plans._SEM}, {plans._FUSED}, k AS (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM fused QUALIFY rank <= 60), l AS (SELECT doc_id, max(quality) * 4 - 2.0 - max(toxic) AS logit FROM labels GROUP BY 1)
SELECT doc_id, (rank - 1) // 6 AS batch, round(CASE WHEN logit IS NULL THEN score ELSE 1 / (1 + exp(-logit)) END, 6) AS rerank FROM k LEFT JOIN l USING (doc_id)""")
def rerank(t: Tables) -> DataFrame:
    """The sixty best in batches of six, with the scores that a reranker left in a table; others keep their own."""
    best = r.rank_each(plans._six(plans._fused(t), "score"), 60, F.desc("score"), F.col("doc_id"))
    logits = t.labels.groupBy("doc_id").agg((F.max("quality") * 4 - 2.0 - F.max("toxic")).alias("logit"))
    rows = logits.join(F.broadcast(best), "doc_id", "right")
    return rows.select("doc_id", F.floor((F.col("rank") - 1) / 6).alias("batch"), F.round(F.coalesce(scores.sigmoid(F.col("logit")), "score"), 6).alias("rerank"))


_QNO = "CAST(regexp_extract(source, '[0-9]+') AS BIGINT)"
_COSINE = f"len(list_intersect({sorted(set(plans.TERMS))}, w)) / sqrt(CAST({len(set(plans.TERMS))} AS DOUBLE) * greatest(len(w), 1))"


@query("h24_sufficiency", f"""WITH i AS (SELECT {_QNO} AS query_id, round(least(1.0, {_COSINE} * 3), 6) AS final, regexp_matches(text, '[0-9]') AS has_number, contains(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), 'the ') AS has_entity FROM (SELECT *, list_distinct({_TOKENS}) AS w FROM documents)),
c AS (SELECT *, has_number OR query_id % 2 = 1 AS fits FROM i) SELECT query_id, bool_or(fits) AS property, bool_or(fits AND has_entity) AS entity, coalesce(max(final) FILTER (WHERE fits AND has_entity), 0) AS confidence, count(*) FILTER (WHERE fits AND has_entity) AS usable,
bool_or(fits) AND bool_or(fits AND has_entity) AND coalesce(max(final) FILTER (WHERE fits AND has_entity), 0) >= 0.32 AS answerable FROM c GROUP BY 1""")
def sufficiency(t: Tables) -> DataFrame:
    """Per query: is there evidence with the property asked for (a number, for every other query) that names the entity,
    with a score of 0.32 or more? One aggregate; nothing is gathered."""
    final = F.round(F.least(F.lit(1.0), scores.set_cosine(F.array(*[F.lit(x) for x in plans.TERMS]), F.col("w")) * 3), 6)
    named = F.lower("text").rlike("the[^a-z0-9]")
    items = r.with_words(t.documents, "source", "text").select(F.regexp_extract("source", r"\d+", 0).cast("long").alias("query_id"), r.once(F.struct(final.alias("final"), F.col("text").rlike("[0-9]").alias("has_number"), named.alias("named"))).alias("i")).select("query_id", "i.*")
    fits = F.col("has_number") | (F.col("query_id") % 2 == 1)
    usable = fits & F.col("named")
    best = F.coalesce(F.max(F.when(usable, F.col("final"))), F.lit(0.0))
    return items.groupBy("query_id").agg(F.bool_or(fits).alias("property"), F.bool_or(usable).alias("entity"), best.alias("confidence"), F.count_if(usable).alias("usable"), (F.bool_or(fits) & F.bool_or(usable) & (best >= 0.32)).alias("answerable"))


_TERMS = sorted(set(plans.TERMS))


@query("h28_cards", f"""WITH w AS (SELECT doc_id, source, lang, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, source, w, CASE WHEN doc_id % 50 = 0 THEN [source] ELSE w[1:8] END AS tw, CASE WHEN doc_id % 50 = 0 THEN source ELSE '' END AS title, CASE doc_id % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.05 ELSE 0 END AS sure, CASE WHEN doc_id % 7 = 0 THEN 0.2 ELSE 0 END AS kind FROM w),
n AS (SELECT count(*) AS n, {", ".join(f"ln(1 + count(*) / (1.0 + count(*) FILTER (WHERE list_contains(w, '{x}')))) AS i{k}" for k, x in enumerate(_TERMS))} FROM c),
z AS (SELECT doc_id, kind, sure, 0.35 * CASE WHEN len(tw) > 0 THEN len(list_filter(tw, lambda x: list_contains({_TERMS}, x))) / sqrt(CAST(len(tw) AS DOUBLE)) ELSE 0 END + 0.3 * ({" + ".join(f"CASE WHEN list_contains(w, '{x}') THEN i{k} ELSE 0 END" for k, x in enumerate(_TERMS))}) / ({" + ".join(f"i{k}" for k in range(len(_TERMS)))}) + 0.2 * (source = 'src3')::INT + CASE WHEN title = 'src3' THEN 0.4 ELSE 0 END AS rel FROM c, n)
SELECT doc_id, round(CASE WHEN rel + kind <= 0 THEN 0 ELSE rel + kind + sure END, 6) AS score FROM z WHERE CASE WHEN rel + kind <= 0 THEN 0 ELSE rel + kind + sure END >= 0.12 ORDER BY 2 DESC, 1 LIMIT 6""")
def cards(t: Tables) -> DataFrame:
    """Cards scored by title, idf-weighted body, entity, exact title, type and confidence; the six best of 0.12 or more."""
    q = F.array(*[F.lit(x) for x in _TERMS])
    w = t.documents.select("doc_id", "source", text.tokens(F.col("text")).alias("w"))
    exact = F.col("doc_id") % 50 == 0
    flags = [F.array_contains("w", x).alias(f"h{k}") for k, x in enumerate(_TERMS)]
    title = F.when(exact, F.array("source")).otherwise(F.slice("w", 1, 8))
    rows = w.select("doc_id", "source", title.alias("tw"), *flags)
    idf = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"h{k}")).alias(f"d{k}") for k in range(len(_TERMS))])
    weights = [F.log(1 + F.col("n") / (1.0 + F.col(f"d{k}"))) for k in range(len(_TERMS))]
    rows = rows.crossJoin(F.broadcast(idf))  # one row
    body = sum((F.when(F.col(f"h{k}"), x).otherwise(0.0) for k, x in enumerate(weights)), F.lit(0.0)) / sum(weights, F.lit(0.0))
    hits = F.size(F.filter("tw", lambda x: F.array_contains(q, x)))
    head = F.when(F.size("tw") > 0, hits / F.sqrt(F.greatest(F.size("tw"), F.lit(1)).cast("double"))).otherwise(0.0)
    relevance = 0.35 * head + 0.3 * body + 0.2 * (F.col("source") == "src3").cast("int") + F.when(exact & (F.col("source") == "src3"), 0.4).otherwise(0.0)
    kind = F.when(F.col("doc_id") % 7 == 0, 0.2).otherwise(0.0)
    sure = F.when(F.col("doc_id") % 3 == 0, 0.15).when(F.col("doc_id") % 3 == 1, 0.05).otherwise(0.0)
    score = F.when(relevance + kind <= 0, 0.0).otherwise(relevance + kind + sure)
    return r.top(rows.select("doc_id", F.round(score, 6).alias("score"), score.alias("raw")).where("raw >= 0.12").drop("raw"), 6, F.desc("score"), F.col("doc_id"))


@query("h29_profile_nodes", f"""WITH {plans._SEM}, d AS (SELECT doc_id, lang, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents), z AS (SELECT doc_id, 0.6 * semantic + least(0.4, CASE WHEN doc_id % 30 > 0 THEN least(0.1, (doc_id % 30) / 240.0) ELSE 0.1 END + CASE WHEN doc_id % 4 = 0 THEN 0.1 ELSE 0 END + 0.2 * len(list_filter({plans.QUERY.split()}, lambda x: length(x) > 2 AND list_contains(w, x))) / {float(len(plans.QUERY.split()))} + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END) AS b FROM d JOIN sem USING (doc_id)) SELECT doc_id, round(b, 6) AS blended, b > 0.55 AS admitted FROM z""")
def profile_nodes(t: Tables) -> DataFrame:
    words = plans.QUERY.split()
    hits = sum((F.array_contains("w", x).cast("int") for x in words if len(x) > 2), F.lit(0)) / float(len(words))
    months = F.col("doc_id") % 30
    boost = F.when(months > 0, F.least(F.lit(0.1), months / 240)).otherwise(0.1) + F.when(F.col("doc_id") % 4 == 0, 0.1).otherwise(0.0) + 0.2 * hits + F.when(F.col("lang") == "en", 0.2).otherwise(0.0)
    rows = t.documents.select("doc_id", "lang", F.split(F.lower("text"), r"\s+").alias("w")).select("doc_id", F.least(F.lit(0.4), boost).alias("boost")).join(plans._semantic(t), "doc_id")
    blended = 0.6 * F.col("semantic") + F.col("boost")
    return rows.select("doc_id", F.round(blended, 6).alias("blended"), (blended > 0.55).alias("admitted"))


REQUESTS = ["question 3", "last 2 questions", "first 2 questions", "the last question", "question 99"]


@query("h31_structural_lookup", f"""WITH {s.SEGMENTS}, q AS (SELECT conv_id, seq, {s.listed(REQUESTS)}[conv_id % {len(REQUESTS)} + 1] AS ask FROM segments), p AS (SELECT *, CAST(nullif(regexp_extract(ask, 'questions? (\\d+)', 1), '') AS INT) AS nth, CAST(nullif(regexp_extract(ask, '(first|last) (\\d+) questions?', 2), '') AS INT) AS many, contains(ask, 'last') AS back,
row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS m FROM q) SELECT conv_id, seq FROM p WHERE CASE WHEN nth IS NOT NULL THEN n = nth WHEN back THEN m <= coalesce(many, 1) ELSE n <= coalesce(many, 1) END""")
def structural_lookup(t: Tables) -> DataFrame:
    """Segments asked for by place: the n-th, the first or the last few."""
    ask = pick(REQUESTS, F.col("conv_id"))
    number = lambda pattern, g: F.nullif(F.regexp_extract(ask, pattern, g), F.lit("")).cast("int")
    rows = transcripts.segments(t.conversations).select("conv_id", "seq", number(r"questions? (\d+)", 1).alias("nth"), number(r"(first|last) (\d+) questions?", 2).alias("many"), ask.contains("last").alias("back"))
    w = Window.partitionBy("conv_id")
    rows = rows.withColumn("n", F.row_number().over(w.orderBy("seq"))).withColumn("m", F.row_number().over(w.orderBy(F.desc("seq"))))
    few = F.coalesce("many", F.lit(1))
    return rows.where(F.when(F.col("nth").isNotNull(), F.col("n") == F.col("nth")).when(F.col("back"), F.col("m") <= few).otherwise(F.col("n") <= few)).select("conv_id", "seq")


SHAPES = ["definitional_answer", "list_answer", "exact_numeric_answer", "document_followup_answer", "document_absent_fact_refusal", "broad_overview"]
ASKED = ["Reason", "there", "of"]
_B = chr(92) + "b"
_ANSWER = rf"""a AS (SELECT *, {" + ".join(f"contains(lower(text), '{e.lower()}')::INT" for e in ASKED if len(e) >= 3)} AS hits, regexp_matches(text, '{_B}\d') AS numeric, regexp_matches(text, '(?i)\b(is|are|refers to|represents|is defined as|can be understood as|consists of)\b') AS defines,
regexp_matches(text, '(?i)\b(RQ\d|research question \d|first|second|third|fourth|phase|stage|step|objective|objects?|models?)\b') OR regexp_matches(text, '(^|\n)\s*([-*•]|\d+[.)])\s+') OR len(regexp_extract_all(text, ';')) >= 2 AS lists, regexp_matches(left(text, 220), '(?i)\b(abstract|introduction|overview|background|methodology|chapter outlines|this thesis is organized|summary)\b') AS generic FROM b),
z AS (SELECT *, greatest(-0.3, least(0.8, CASE WHEN hits > 0 THEN least(0.25, hits * 0.08) ELSE 0 END + CASE WHEN shape = 'definitional_answer' AND defines THEN 0.35 ELSE 0 END + CASE WHEN shape = 'list_answer' AND lists THEN 0.35 ELSE 0 END + CASE WHEN shape = 'exact_numeric_answer' AND numeric THEN 0.35 ELSE 0 END
+ CASE WHEN shape = 'document_followup_answer' AND (hits > 0 OR numeric) THEN 0.2 ELSE 0 END - CASE WHEN generic AND shape <> 'broad_overview' THEN 0.18 ELSE 0 END - CASE WHEN shape = 'document_absent_fact_refusal' AND hits = 0 AND NOT numeric THEN 0.1 ELSE 0 END)) AS score FROM a)"""


@query("h39_answerability", f"WITH b AS (SELECT doc_id, text, {s.listed(SHAPES)}[doc_id % 6 + 1] AS shape FROM documents), {_ANSWER} SELECT doc_id, round(score, 6) AS score, hits > 0 AS entity, numeric, lists, defines FROM z")
def answerability(t: Tables) -> DataFrame:
    found = rules.answerability(F.col("text"), pick(SHAPES, F.col("doc_id")), ASKED)
    return t.documents.select("doc_id", found.alias("a")).select("doc_id", F.round("a.score", 6).alias("score"), "a.entity", "a.numeric", "a.lists", "a.defines")


@query("h42_coverage", f"""WITH b AS (SELECT {_QNO} AS query_id, text, {s.listed(SHAPES)}[{_QNO} % 6 + 1] AS shape FROM documents WHERE text <> ''), {_ANSWER}, g AS (SELECT query_id, any_value(shape) AS shape, round(max(score), 6) AS top, bool_or(numeric) AS numeric, bool_or(lists) AS lists FROM z GROUP BY 1)
SELECT query_id, top, CASE WHEN shape = 'document_absent_fact_refusal' AND top < 0.18 THEN 'absent_fact_no_answer_coverage' WHEN shape = 'exact_numeric_answer' AND NOT numeric THEN 'numeric_question_no_numeric_evidence' WHEN shape = 'list_answer' AND NOT lists THEN 'weak_list_coverage' ELSE 'sufficient_evidence' END AS reason FROM g""")
def coverage(t: Tables) -> DataFrame:
    """Per query: the best answerability of its passages and whether to refuse."""
    number = F.regexp_extract("source", r"\d+", 0).cast("long")
    rows = t.documents.where("text <> ''").select(number.alias("query_id"), pick(SHAPES, number).alias("shape"), "text")
    rows = rows.select("query_id", "shape", rules.answerability(F.col("text"), F.col("shape"), ASKED).alias("a"))
    got = rows.groupBy("query_id", "shape").agg(F.round(F.max("a.score"), 6).alias("top"), F.bool_or("a.numeric").alias("numeric"), F.bool_or("a.lists").alias("lists"))
    reason = F.when((F.col("shape") == "document_absent_fact_refusal") & (F.col("top") < 0.18), "absent_fact_no_answer_coverage").when((F.col("shape") == "exact_numeric_answer") & ~F.col("numeric"), "numeric_question_no_numeric_evidence").when((F.col("shape") == "list_answer") & ~F.col("lists"), "weak_list_coverage").otherwise("sufficient_evidence")
    return got.select("query_id", "top", reason.alias("reason"))


@query("h41_evidence_tiers", f"""WITH i AS (SELECT {_QNO} AS query_id, round(least(1.0, {_COSINE} * 4), 6) AS score, lang FROM (SELECT *, list_distinct({_TOKENS}) AS w FROM documents)), g AS (SELECT query_id, count(*) FILTER (WHERE score > 0) AS cards, coalesce(max(score), 0) AS top, round(avg(score), 6) AS mean, bool_or(score > 0 AND lang = 'es') AS named FROM i GROUP BY 1)
SELECT query_id, top, mean, CASE WHEN cards = 0 THEN 4 WHEN query_id % 5 = 0 THEN 2 WHEN top >= 0.6 AND (named OR query_id % 3 <> 0) THEN 1 WHEN top >= 0.3 THEN 2 ELSE 3 END AS tier FROM g""")
def evidence_tiers(t: Tables) -> DataFrame:
    """Tier 1 to 4 of a query's evidence: every fifth query asks for a synthesis, every third names an entity (here, a language)."""
    score = F.round(F.least(F.lit(1.0), scores.set_cosine(F.array(*[F.lit(x) for x in plans.TERMS]), F.col("w")) * 4), 6)
    rows = r.with_words(t.documents, "source", "lang").select(F.regexp_extract("source", r"\d+", 0).cast("long").alias("query_id"), r.once(score).alias("score"), "lang")
    got = rows.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("cards"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top"), F.round(F.avg("score"), 6).alias("mean"), F.bool_or((F.col("score") > 0) & (F.col("lang") == "es")).alias("named"))
    tier = F.when(F.col("cards") == 0, 4).when(F.col("query_id") % 5 == 0, 2).when((F.col("top") >= 0.6) & (F.col("named") | (F.col("query_id") % 3 != 0)), 1).when(F.col("top") >= 0.3, 2).otherwise(3)
    return got.select("query_id", "top", "mean", tier.alias("tier"))


@query("c12_edge_join", "WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, min(l_orderkey) AS rel FROM lineitem GROUP BY 1, 2), b AS (SELECT src AS node, dst AS other, rel FROM e UNION ALL SELECT dst, src, rel FROM e), d AS (SELECT node, count(*) AS degree FROM b GROUP BY 1) SELECT b.node, other, rel, degree AS other_degree FROM b JOIN d ON d.node = b.other")
def edge_join(t: Tables) -> DataFrame:
    """Each relation from both of its ends: the node, the other side and how many relations that has."""
    edges = t.lineitem.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).agg(F.min("l_orderkey").alias("rel"))
    ends = graph.both_ways(edges).select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel")
    return ends.join(graph.degrees(edges).select(F.col("node").alias("other"), F.col("degree").alias("other_degree")), "other")


@query("i14_numeral_tokens")
def numeral_tokens(t: Tables) -> DataFrame:
    tails = ["", " about ten thousand", " 10k or 1,250,000", " well-known 1.5 million", " two hundred and fifty"]
    rows = t.documents.select("doc_id", F.concat("text", pick(tails, F.col("doc_id"))).alias("text"))
    return extraction.flat_map(rows, lambda row: [(w,) for w in extraction.lexical_tokens(row["text"] or "")], "doc_id", "term string").groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.count_if(F.col("term").rlike(r"^\d+$")).alias("numbers"))


@query("i12_document_chunks")
def document_chunks(t: Tables) -> DataFrame:
    table = F.lit("id,kind,size\n1,a,3\n2,b,4\n3,c,5")
    marked = F.when(F.col("doc_id") % 10 == 0, table).otherwise(F.concat(F.lit("1 Start ...... 1\n[Page 1] "), "text"))
    return extraction.flat_map(t.documents.select("doc_id", marked.alias("text")), lambda row: extraction.document_chunks(row["text"] or ""), "doc_id", "kind string, start long, end long, text string")


@query("i23_relations")
def found_relations(t: Tables) -> DataFrame:
    tails = [" Redis uses Kafka.", " Kafka is unlike Redis and extends Spark.", " Redis, not related to Spark, uses a laptop.", " Spark is based on Kafka (Redis)."]
    rows = t.documents.select("doc_id", F.concat("text", pick(tails, F.col("doc_id"))).alias("text"), pick(["Redis", "Kafka", "Redis", "Spark"], F.col("doc_id")).alias("subject"))
    return extraction.flat_map(rows, lambda row: extraction.relations(row["subject"], row["text"] or "", ["Redis", "Kafka", "Spark"]), "doc_id", "predicate string, object string, confidence string")


@query("i25_front_matter")
def found_front_matter(t: Tables) -> DataFrame:
    head = F.concat(F.lit("[Page 1]\nTitle A study of "), "source", F.lit("\nDate 21 June 2025 Number of pages "), (F.col("doc_id") % 90).cast("string"), F.lit(" Language "), "lang", F.lit("\nSupervisors Dr. A, Prof. B and C\n[Page 9]\nAuthor Nobody\n"), "text")
    return extraction.flat_map(t.documents.select("doc_id", head.alias("text")), lambda row: extraction.front_matter(row["text"] or ""), "doc_id", "property string, value string, items array<string>, page int")


@query("l6_final_segments", f"WITH {s.SEGMENTS}, f AS (SELECT conv_id, seq, text, seq % 3 <> 1 AS final, max(seq) FILTER (WHERE seq % 3 <> 1) OVER (PARTITION BY conv_id) AS last, max(seq) OVER (PARTITION BY conv_id) AS end FROM segments) SELECT conv_id, seq, NOT final AS flushed FROM f WHERE final OR (seq = \"end\" AND seq > coalesce(last, -1))")
def final_segments(t: Tables) -> DataFrame:
    """Final segments, and the interim one that is still open when a conversation ends."""
    rows = transcripts.segments(t.conversations).select("conv_id", "seq", (F.col("seq") % 3 != 1).alias("final"))
    open_ = rows.groupBy("conv_id").agg(F.max(F.when(F.col("final"), F.col("seq"))).alias("last"), F.max("seq").alias("end"))
    left = open_.where(F.col("end") > F.coalesce("last", F.lit(-1))).select("conv_id", F.col("end").alias("seq"), F.lit(True).alias("flushed"))
    return rows.where("final").select("conv_id", "seq", F.lit(False).alias("flushed")).unionByName(left)


@query("l7_interim_novelty")
def interim_novelty(t: Tables) -> DataFrame:
    """What an interim segment adds to the ten finals before it (a window of ten rows, then a small function per row)."""
    rows = transcripts.segments(t.conversations)
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(-10, -1)
    finals = F.collect_list("text").over(before)
    interim = F.when(F.col("seq") % 2 == 0, F.concat(F.coalesce(F.get(finals, F.size(finals) - 1), F.lit("")), F.lit(" "), "text")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "seq", interim.alias("interim"), finals.alias("finals"), (F.col("seq") * 5000).alias("age"))
    return extraction.flat_map(rows, lambda row: [(row["seq"], *folds.interim_novelty(row["interim"], list(row["finals"]), row["age"]))], "conv_id", "seq long, action string, text string")


@query("l17_pending_question")
def pending_question(t: Tables) -> DataFrame:
    rows = transcripts.segments(t.conversations).select("conv_id", F.col("timestamp_ms").alias("at_ms"), (F.col("speaker") == "user").cast("int").alias("own"), "text")
    return fold_batch(rows, "conv_id", "at_ms", folds.pending_question(), "pending int, echo int, fired int")
