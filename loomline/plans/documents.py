"""Queries over documents and pages: redaction, similarity, chunking, sources, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import scores, text
from loomline.functions.rules import SECTION_STOPWORDS
from loomline.operators import chunks, codeblocks, graph, outline, sections, similarity
from loomline.registry import Tables, query

_STOP = "the|a|an|to|for|and|or|of|in|on|by|with|from"


@query("a8_page_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<(noscript|template)\b.*?</(noscript|template)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query("k4_page_type", r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)monaco-editor|CodeMirror-code|cm-content') OR (regexp_matches(html, '(?i)<(pre|code)\b') AND length(html) < 800) THEN 'coding' WHEN length(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>', '', 'g')) >= 500 THEN 'article' ELSE 'app' END AS kind FROM pages""")
def page_type(t: Tables) -> DataFrame:
    html = F.col("html")
    readable = F.length(F.regexp_replace(F.regexp_extract(html, r"(?s)<article>(.*?)(?:</article>|\z)", 1), "<[^>]*>", ""))
    coding = html.rlike("(?i)monaco-editor|CodeMirror-code|cm-content") | (html.rlike(r"(?i)<(pre|code)\b") & (F.length(html) < 800))
    return t.pages.select("page_id", F.when(coding, "coding").when(readable >= 500, "article").otherwise("app").alias("kind"))


_SIGNALS = [("known_host", 50, "url", r"(^|\.)(leetcode\.com|hackerrank\.com|codeforces\.com)"), ("problem_url", 25, "url", r"/(problems?|challenge|contest)/"), ("selection", 10, "html", r"<h1>[^<]{40,}"), ("constraints", 20, "html", r"(?i)constraints|input format|output format"), ("editor", 15, "html", r"(?i)codemirror|monaco-editor"), ("submit", 10, "html", r"(?i)submit|run code|test case"), ("password", -60, "html", r"(?i)type=.password"), ("payment", -40, "html", r"(?i)checkout|credit card|payment"), ("navigation", -30, "html", r"(<li><a [^>]*>[^<]*</a></li>){6,}"), ("login", -20, "html", r"(?i)sign in|log in")]


@query("k6_signal_score", "SELECT page_id, score, CASE WHEN contains(url, 'adult') THEN 'blocked' WHEN score >= 80 THEN 'auto' WHEN score >= 50 THEN 'ask' ELSE 'manual' END AS band FROM (SELECT page_id, url, " + " + ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN {n} ELSE 0 END" for _, n, c, p in _SIGNALS) + " AS score FROM pages)")
def signal_score(t: Tables) -> DataFrame:
    total = sum((F.when(F.col(c).rlike(p), n).otherwise(0) for _, n, c, p in _SIGNALS), F.lit(0))
    band = F.when(F.col("url").contains("adult"), "blocked").when(F.col("score") >= 80, "auto").when(F.col("score") >= 50, "ask").otherwise("manual")
    return t.pages.select("page_id", "url", total.alias("score")).select("page_id", "score", band.alias("band"))


@query("k5_assembled_page", r"""SELECT page_id, left(concat('TITLE: ', regexp_extract(html, '<title>(.*?)</title>', 1), chr(10), chr(10), 'HEADINGS:', chr(10), regexp_extract(html, '<h1>(.*?)</h1>', 1), chr(10), chr(10), '---', chr(10), chr(10), regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>', ' ', 'g')), 25000) AS payload FROM pages""")
def assembled_page(t: Tables) -> DataFrame:
    """Title and headings, then the body, cut at 25,000 characters (the limit is the operator's)."""
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*?)(?:</article>|\z)", 1), "<[^>]*>", " ")
    front = F.concat(F.lit("TITLE: "), F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit("\n\nHEADINGS:\n"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1))
    return t.pages.select("page_id", F.left(F.concat(front, F.lit("\n\n---\n\n"), body), F.lit(25000)).alias("payload"))


@query("i33_sanitised_urls", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, concat(scheme, '://', host, regexp_replace(array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN contains(s, '@') AND contains(s, '.') THEN ':email' WHEN regexp_matches(s, '^\d{6,}$') THEN ':id' WHEN length(regexp_extract(s, '[A-Za-z0-9]{16,}')) >= 16 AND regexp_matches(s, '\d') THEN ':token' ELSE s END), '/'), '/{2,}', '/', 'g')) AS url FROM p""")
def sanitised_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.sanitise_url(F.col("url")).alias("url"))


_FAKE = "concat(text, CASE WHEN doc_id % 17 = 0 THEN ' Bearer abcdef1234567890XYZ sk-ABCDEFGHIJKLMNOPQRSTUV' ELSE '' END)"


@query("i27_redact", rf"""SELECT doc_id, md5(r) AS digest, contains(r, '[REDACTED]') AS hit FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FAKE}, '(?i)Bearer\s+[A-Za-z0-9._~+/=:-]{{12,}}', '[REDACTED]', 'g'), '(?i)sk-[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g'), '(?i)gsk_[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g'), '(?i)dg_[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g'), '[A-Za-z0-9_-]{{24,}}\.[A-Za-z0-9_-]{{6,}}\.[A-Za-z0-9_-]{{20,}}', '[REDACTED]', 'g') AS r FROM documents)""")
def redact(t: Tables) -> DataFrame:
    faked = F.concat("text", F.when(F.col("doc_id") % 17 == 0, " Bearer abcdef1234567890XYZ sk-ABCDEFGHIJKLMNOPQRSTUV").otherwise(""))
    return t.documents.select("doc_id", text.redact(faked).alias("r")).select("doc_id", F.md5("r").alias("digest"), F.col("r").contains("[REDACTED]").alias("hit"))


@query("i34_log_redact", r"""SELECT doc_id, regexp_matches(t, 'AIza[A-Za-z0-9_-]{20,}') AS had, left(regexp_replace(t, 'AIza[A-Za-z0-9_-]{20,}', '[REDACTED]', 'g'), 120) AS preview FROM (SELECT doc_id, concat(CASE WHEN doc_id % 17 = 0 THEN 'AIzaABCDEFGHIJKLMNOPQRSTUVWX ' ELSE '' END, text) AS t FROM documents)""")
def log_redact(t: Tables) -> DataFrame:
    """A 120-character preview is the operator's own output."""
    rows = t.documents.select("doc_id", F.concat(F.when(F.col("doc_id") % 17 == 0, "AIzaABCDEFGHIJKLMNOPQRSTUVWX ").otherwise(""), "text").alias("t"))
    return rows.select("doc_id", F.col("t").rlike("AIza[A-Za-z0-9_-]{20,}").alias("had"), F.left(text.redact(F.col("t"), text.LOG_SECRET_FORMS), F.lit(120)).alias("preview"))


@query("i31_content_ids", "SELECT doc_id, substring(sha256(text), 1, 16) AS content_id, source || ':' || substring(md5(lang || source), 1, 8) AS scope_id FROM documents")
def content_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_id"), F.concat("source", F.lit(":"), F.substring(F.md5(F.concat("lang", "source")), 1, 8)).alias("scope_id"))


@query("i15_token_estimate", "SELECT lang, count(*) AS n, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query("b15_placeholder_documents", r"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '[Page 1] ' || left(text, 30) ELSE text END AS t FROM documents) WHERE contains(t, '[Page ') AND length(regexp_replace(regexp_replace(t, '\[Page \d+\]', '', 'g'), '\s', '', 'g')) < 40")
def placeholder_documents(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("[Page 1] "), F.left("text", F.lit(30)))).otherwise(F.col("text")).alias("t"))
    bare = F.regexp_replace(F.regexp_replace("t", r"\[Page \d+\]", ""), r"\s", "")
    return rows.where(F.col("t").contains("[Page ") & (F.length(bare) < 40)).select("doc_id")


@query("b19_injection_patterns", r"SELECT doc_id FROM (SELECT doc_id, text || CASE WHEN doc_id % 31 = 0 THEN ' ignore all previous instructions' ELSE '' END AS t FROM documents) WHERE regexp_matches(t, '(?i)ignore (all |any )?(previous|prior) instructions|system prompt|you are now')")
def injection_patterns(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 31 == 0, " ignore all previous instructions").otherwise("")).alias("t"))
    return rows.where(F.col("t").rlike("(?i)ignore (all |any )?(previous|prior) instructions|system prompt|you are now")).select("doc_id")


@query("b18_page_signals", r"SELECT page_id, regexp_matches(html, '(?i)type=.?password') AS password, regexp_matches(html, '(?i)cc-number|card') AS card, regexp_matches(lower(html), 'checkout|payment|billing') AS payment FROM pages")
def page_signals(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.col("html").rlike("(?i)type=.?password").alias("password"), F.col("html").rlike("(?i)cc-number|card").alias("card"), F.lower("html").rlike("checkout|payment|billing").alias("payment"))


@query("g1_page_markers", r"SELECT doc_id, least(5000, list_max(list_transform(regexp_extract_all('[Page ' || CAST(doc_id % 7 + 1 AS VARCHAR) || '] ' || text, '\[Page (\d+)\]', 1), lambda x: CAST(x AS INT)))) AS pages FROM documents")
def page_markers(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("[Page "), (F.col("doc_id") % 7 + 1).cast("string"), F.lit("] "), "text")
    pages = F.transform(F.regexp_extract_all(marked, F.lit(r"\[Page (\d+)\]"), 1), lambda x: x.cast("int"))
    return t.documents.select("doc_id", F.least(F.lit(5000), F.array_max(pages)).alias("pages"))


_WORDS = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\b({_STOP})\b', ' ', 'g'), '\s+'), lambda w: w <> ''))"


@query("c11_similarity_join", rf"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), l AS (SELECT doc_id, {_WORDS} AS w FROM d),
h AS (SELECT doc_id, item_id, len(list_intersect(l.w, b.w)) / CAST(least(len(l.w), len(b.w)) AS DOUBLE) AS c FROM l, b WHERE least(len(l.w), len(b.w)) >= 3)
SELECT doc_id, min(item_id) AS item_id FROM h WHERE c >= 0.6 GROUP BY doc_id""")
def similarity_join(t: Tables) -> DataFrame:
    """Lines that share 60 % of the smaller word set with a reference passage; the first passage counts."""
    words = lambda c: text.overlap_words(F.col(c), _STOP)
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", words("t").alias("w")).where(F.size("w") >= 3)
    items = t.benchmark.select("item_id", words("text").alias("w")).where(F.size("w") >= 3)
    return similarity.containment_join(lines, ["doc_id", "line"], items, ["item_id"]).groupBy("doc_id").agg(F.min("item_id").alias("item_id"))


@query("g5_two_hop", """WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, min(l_orderkey) AS rel FROM lineitem GROUP BY 1, 2), b AS (SELECT src, dst, rel FROM e UNION ALL SELECT dst, src, rel FROM e),
h1 AS (SELECT dst AS node, min(rel) AS rel FROM b WHERE src = 5 AND dst <> 5 GROUP BY 1), h2 AS (SELECT b.dst AS node, min(b.rel) AS rel FROM b JOIN h1 ON b.src = h1.node WHERE b.dst <> 5 AND b.dst NOT IN (SELECT node FROM h1) GROUP BY 1)
SELECT node, 1 AS depth, rel FROM h1 UNION ALL SELECT node, 2, rel FROM h2""")
def two_hop(t: Tables) -> DataFrame:
    relations = t.lineitem.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).agg(F.min("l_orderkey").alias("rel"))
    start = t.spark.createDataFrame([(5,)], "node long")
    return graph.expand(relations, start)


@query("i36_entity_rollup", r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS name FROM documents) SELECT lower(name) AS slug, min(name) AS name, count(DISTINCT doc_id) AS cards FROM e GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def entity_rollup(t: Tables) -> DataFrame:
    names = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), 0)).alias("name"))
    rolled = names.groupBy(F.lower("name").alias("slug")).agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count_distinct("doc_id").alias("cards"))
    return rolled.where("cards >= 3")


_TITLE = r"<title>([^<]*)</title>"


@query("k3_code_blocks", rf"""WITH h AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '{_TITLE}', 1), '&(amp|lt|gt|quot)$', '&\1;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS t FROM pages), b AS (SELECT page_id, 'def f():' || chr(10) || '    return "' || t || '" < 1' AS one, repeat(t || ' = x; ', CASE WHEN page_id % 9 = 0 THEN 300 ELSE 1 END) AS two FROM h),
w AS (SELECT page_id, one || chr(10) || chr(10) || trim(two) || chr(10) || chr(10) || 'x[' || CAST(page_id AS VARCHAR) || ']' || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || 'line 1' || chr(10) || chr(10) || '  line 2' ELSE '' END AS w FROM b)
SELECT page_id, CASE WHEN length(w) > 8000 THEN left(w, 8000) || chr(10) || '…(code truncated)' ELSE w END AS code FROM w""")
def code_on_pages(t: Tables) -> DataFrame:
    """The pages hold no code, so blocks around each page's title are put before its end: nested, repeated, long, in an editor."""
    title = F.regexp_extract("html", _TITLE, 1)
    long = F.repeat(F.concat(title, F.lit(" = x; ")), F.when(F.col("page_id") % 9 == 0, 300).otherwise(1))
    editor = F.when(F.col("page_id") % 2 == 0, "<div class='box monaco-editor'><div class=view-lines><div class='view-line x'>line 1</div><div class=view-line> </div><div class='view-line'>&nbsp; line <b>2</b></div></div></div>").otherwise("")
    one = F.concat(F.lit("<pre class=a>def f():\r\n    return <code>\""), title, F.lit("\"</code> &lt; 1  \n</pre>"))
    blocks = F.concat(F.lit("<code>x["), F.col("page_id").cast("string"), F.lit("]</code><code>plain</code>"), one, F.lit("<div><pre>"), long, F.lit("</pre></div>"), one, editor, F.lit("</body></html>"))
    return codeblocks.pages_with_code(t.pages.select("page_id", F.concat(F.regexp_replace("html", "</body></html>$", ""), blocks).alias("html")))


@query("a7_table_rows")
def table_rows(t: Tables) -> DataFrame:
    made = F.concat(F.lit("id,kind,size\n"), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 4 + 2).cast("int")), lambda i: F.concat(i.cast("string"), F.lit(",k"), F.col("lang"), F.lit(","), (i * 3).cast("string"))), "\n"))
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 10 == 0, made).otherwise(F.col("text")).alias("text"))
    return chunks.chunk_documents(rows, chunks.table_rows)


@query("i8_sentence_windows")
def sentence_windows(t: Tables) -> DataFrame:
    return chunks.chunk_documents(t.documents, chunks.by_words)


@query("i9_character_chunks")
def character_chunks(t: Tables) -> DataFrame:
    return chunks.chunk_documents(t.documents, chunks.by_characters)


@query("i10_sentence_chunks")
def sentence_chunks(t: Tables) -> DataFrame:
    return chunks.chunk_documents(t.documents, chunks.by_sentences)


_HEADED_SQL = r"""m AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 6 WHEN 0 THEN '[Page ' || CAST((i - 1) // 6 + 1 AS VARCHAR) || ']' || chr(10) || x
WHEN 2 THEN CAST((i - 1) // 6 + 1 AS VARCHAR) || ' Heading ' || regexp_replace(string_split(x, ' ')[1], '[^A-Za-z]', '', 'g') || chr(10) || x WHEN 4 THEN CAST((i - 1) // 6 + 1 AS VARCHAR) || '.1 Part ' || regexp_replace(string_split(x, ' ')[1], '[^A-Za-z]', '', 'g') || chr(10) || 'a' || chr(9) || 'b' || chr(10) || x
WHEN 5 THEN x || chr(10) || 'Chapter ..... 3' ELSE x END), chr(10)) AS text FROM documents)"""
_KIND_SQL = r"CASE WHEN regexp_matches(text, '^\s*\[Page (\d{1,6})\]\s*$') THEN 'page' WHEN regexp_matches(text, '\.{4,}\s*\d+\s*$') THEN 'contents' WHEN regexp_matches(text, '^\s*(\d{1,3}(?:\.\d{1,3})*)[.)]?\s+([A-Z][^.]{2,80})$') THEN 'heading' WHEN regexp_matches(text, '^[^\t|]+(?:[\t|][^\t|]+)+$') THEN 'row' WHEN trim(text) = '' THEN 'empty' ELSE 'text' END"


@query("i11_document_map", "WITH " + _HEADED_SQL + rf""", l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS text FROM m, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)), k AS (SELECT *, length(text) AS length, {_KIND_SQL} AS kind FROM l),
o AS (SELECT *, coalesce(sum(length + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, coalesce(last_value(CASE WHEN kind = 'page' THEN CAST(regexp_extract(text, '\d+') AS INT) END IGNORE NULLS) OVER w, 1) AS page, count(*) FILTER (WHERE kind = 'heading') OVER w AS section,
CASE WHEN kind = 'heading' THEN regexp_extract(text, '^\s*([\d.]*\d)', 1) END AS num, CASE WHEN kind = 'heading' THEN trim(regexp_extract(text, '^\s*\d{{1,3}}(?:\.\d{{1,3}})*[.)]?\s+([A-Z][^.]{{2,80}})$', 1)) END AS title FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
g AS (SELECT doc_id, section, max(num) AS num, max(title) AS title, min(page) FILTER (WHERE kind <> 'page') AS page_start, max(page) FILTER (WHERE kind <> 'page') AS page_end, min(start) AS start, max(start + length) AS "end", count(*) FILTER (WHERE kind = 'row') AS n_rows, count(*) FILTER (WHERE kind = 'contents') AS n_contents, count(*) FILTER (WHERE kind = 'text') AS n_text FROM o GROUP BY 1, 2)
SELECT g.*, CASE WHEN num IS NOT NULL THEN len(string_split(num, '.')) END AS level, (SELECT max(p.section) FROM g p WHERE p.doc_id = g.doc_id AND p.section < g.section AND contains(g.num, '.') AND p.num = regexp_replace(g.num, '\.\d+$', '')) AS parent FROM g""")
def document_map(t: Tables) -> DataFrame:
    """The texts hold no headings, so lines of each are led by page markers, headings, rows and lines of contents."""
    n = lambda i: (F.floor(i / 6) + 1).cast("string")
    first = lambda x: F.regexp_replace(F.element_at(F.split(x, " "), 1), "[^A-Za-z]", "")

    def led(x, i):
        head = F.concat(n(i), F.lit(" Heading "), first(x), F.lit("\n"), x)
        part = F.concat(n(i), F.lit(".1 Part "), first(x), F.lit("\na\tb\n"), x)
        return F.when(i % 6 == 0, F.concat(F.lit("[Page "), n(i), F.lit("]\n"), x)).when(i % 6 == 2, head).when(i % 6 == 4, part).when(i % 6 == 5, F.concat(x, F.lit("\nChapter ..... 3"))).otherwise(x)

    marked = F.array_join(F.transform(F.split("text", "\n"), led), "\n")
    return outline.document_map(t.documents.select("doc_id", marked.alias("text")))


_TITLED = """ln AS (SELECT doc_id AS map_id, i AS pos, string_split(text, chr(10))[i] AS body FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
sec AS (SELECT map_id, CAST(pos AS VARCHAR) AS num, pos, array_to_string(string_split(body, ' ')[1:4], ' ') || CASE WHEN pos % 2 = 0 THEN ' Part ' || CAST(pos % 3 AS VARCHAR) ELSE '' END AS heading, lower(body) AS body FROM ln),
ends AS (SELECT map_id, max(pos) AS last FROM ln GROUP BY 1),
qs AS (SELECT map_id, 1 AS query_id, lower('what ' || array_to_string(string_split(body, ' ')[2:7], ' ')) AS q FROM ln JOIN ends USING (map_id) WHERE pos = last
UNION ALL SELECT map_id, 2, lower('part 2 ' || array_to_string(string_split(body, ' ')[3:6], ' ')) FROM ln JOIN ends USING (map_id) WHERE pos = (last + 1) // 2)"""
_LONG = "list_filter(string_split(regexp_replace({0}, '[^a-z0-9#-]+', ' ', 'g'), ' '), lambda w: length(w) > 2)"
_ORDINALS = r"list_filter(regexp_split_to_array(regexp_replace({0}, '[^0-9\s]+', ' ', 'g'), '\s+'), lambda d: regexp_full_match(d, '\d{{1,2}}'))"
_STOPPED = "[" + ", ".join(f"'{w}'" for w in SECTION_STOPWORDS) + "]"
_SECTION_SQL = rf"""WITH {_TITLED}, s AS MATERIALIZED (SELECT map_id, num, pos, regexp_replace(heading, '^\d+(\.\d+)*\s+', '') AS heading, body FROM sec),
q AS MATERIALIZED (SELECT *, list_distinct({_LONG.format('q')}) AS words, {_ORDINALS.format('q')} AS numbers FROM qs),
tt AS MATERIALIZED (SELECT map_id, num, pos, unnest({_LONG.format('lower(heading)')}) AS tw, unnest(list_filter(string_split(regexp_replace(heading, '[^A-Za-z0-9#-]+', ' ', 'g'), ' '), lambda w: length(w) > 2)) AS own FROM s),
df AS (SELECT map_id, tw, count(DISTINCT num) AS df FROM tt GROUP BY 1, 2),
sc AS (SELECT map_id, query_id, num, pos, round(sum(CASE WHEN list_contains(words, tw) THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(q, tw) THEN 0.5::DOUBLE ELSE 0 END) / sqrt(count(*)), 9) AS score,
count(*) FILTER (WHERE list_contains(words, tw)) AS hits, bool_or((list_contains(words, tw) OR contains(q, tw)) AND df <= 2 AND (regexp_matches(tw, '[^a-z]') OR regexp_full_match(own, '[A-Z]{{2,}}'))) AS apart
FROM tt JOIN df USING (map_id, tw) JOIN q USING (map_id) GROUP BY 1, 2, 3, 4),
strong AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY map_id, query_id ORDER BY score DESC, pos) AS place FROM sc WHERE score >= 1 AND (hits >= 2 OR apart) QUALIFY place <= 4),
f AS MATERIALIZED (SELECT *, list_distinct(regexp_extract_all(body, '[a-z][a-z-]*')) AS own FROM s WHERE body <> ''),
p AS MATERIALIZED (SELECT map_id, word, num, pos FROM (SELECT DISTINCT map_id, unnest(words) AS word FROM q) a JOIN f USING (map_id) WHERE contains(body, word) OR (length(word) >= 4 AND NOT regexp_matches(word, '\d')
AND len(list_filter(own, lambda w: length(w) >= 4 AND ((abs(length(w) - length(word)) <= 1 AND levenshtein(w, word) = 1) OR (suffix(word, 'y') AND w = word[:-2] || 'ies')))) > 0)),
n AS (SELECT map_id, word, count(*) AS n FROM p GROUP BY 1, 2), z AS (SELECT map_id, count(*) AS total FROM f GROUP BY 1),
idf AS (SELECT map_id, query_id, num, sum(ln((total + 1) / (n + 1)::DOUBLE)) AS idf FROM (SELECT map_id, query_id, unnest(list_filter(words, lambda w: NOT list_contains({_STOPPED}, w))) AS word FROM q) c JOIN p USING (map_id, word) JOIN n USING (map_id, word) JOIN z USING (map_id) GROUP BY 1, 2, 3),
pool AS (SELECT map_id, query_id, num, pos, len(numbers) > 0 AS counted, len(list_filter({_ORDINALS.format('lower(heading)')}, lambda d: NOT list_contains(numbers, d))) > 0 AS wrong, coalesce(idf, 0) AS idf,
len(list_filter(words, lambda w: NOT list_contains({_STOPPED}, w) AND contains(lower(heading), w))) AS titled FROM q JOIN f USING (map_id) LEFT JOIN idf USING (map_id, query_id, num) WHERE len(list_filter(words, lambda w: NOT list_contains({_STOPPED}, w))) > 0),
b AS (SELECT *, round(idf + 2.0::DOUBLE * titled - CASE WHEN counted AND wrong THEN 3.0::DOUBLE ELSE 0 END, 9) AS score FROM pool),
c AS (SELECT *, max(score) OVER (PARTITION BY map_id, query_id) AS top FROM b WHERE score > 0 OR (counted AND NOT wrong)),
k AS (SELECT *, row_number() OVER (PARTITION BY map_id, query_id ORDER BY score DESC, pos) AS place FROM c WHERE score >= greatest(top * 0.8, top - 1.5) QUALIFY place <= 3),
known AS (SELECT map_id, query_id, list(DISTINCT tw) AS known FROM strong JOIN tt USING (map_id, num) GROUP BY 1, 2),
more AS (SELECT DISTINCT map_id, query_id, num, p.pos FROM (SELECT map_id, query_id, unnest(list_filter(words, lambda w: NOT list_contains(known, w))) AS word FROM q JOIN known USING (map_id, query_id)) w JOIN p USING (map_id, word) WHERE (map_id, query_id, num) NOT IN (SELECT (map_id, query_id, num) FROM strong)),
m AS (SELECT map_id, query_id, num, 0 AS kind, place AS at_ FROM strong UNION ALL SELECT map_id, query_id, num, 1, pos FROM more UNION ALL SELECT map_id, query_id, num, 0, place FROM k WHERE (map_id, query_id) NOT IN (SELECT (map_id, query_id) FROM strong))
SELECT map_id, query_id, CAST(row_number() OVER (PARTITION BY map_id, query_id ORDER BY kind, at_) AS INT) AS place, num FROM m QUALIFY place <= 4"""


@query("h30_section_targets", _SECTION_SQL)
def section_targets(t: Tables) -> DataFrame:
    """Lines of documents as sections, titled by their first words; each map is asked for its last line and for a line in the middle."""
    lines = t.documents.select(F.col("doc_id").alias("map_id"), F.posexplode(F.split("text", "\n")).alias("at", "body")).withColumn("pos", F.col("at") + 1)
    some = lambda a, n: F.array_join(F.slice(F.split("body", " "), a, n), " ")
    part = F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" Part "), (F.col("pos") % 3).cast("string"))).otherwise("")
    titled = lines.select("map_id", F.col("pos").cast("string").alias("num"), "pos", F.concat(some(1, 4), part).alias("heading"), "body")
    split = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("map_id"), F.split("text", "\n").alias("all"))
    one = split.select("map_id", F.element_at("all", -1).alias("body")).select("map_id", F.lit(1).alias("query_id"), F.concat(F.lit("Can you tell me what "), some(2, 6)).alias("text"))
    two = split.select("map_id", F.element_at("all", F.expr("CAST((size(all) + 1) div 2 AS INT)")).alias("body")).select("map_id", F.lit(2).alias("query_id"), F.concat(F.lit("Part 2 "), some(3, 4)).alias("text"))
    return sections.target_sections(titled, one.unionByName(two))
