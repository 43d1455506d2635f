"""Fragments of oracle SQL that several queries share."""

from __future__ import annotations

TOKENS = """list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[''’]s\\b', '', 'g'), '[''’]', '', 'g'), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: length(w) > 2)"""


def tokens(column: str) -> str:
    return TOKENS.format(column)


def bm25(terms: list[str], k1: float = 1.5, b: float = 0.75) -> str:
    """A query giving doc_id and score of documents with a term."""
    distinct = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(distinct))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(len(distinct)))
    parts = " + ".join(f"{float(terms.count(t))} * greatest(0.0, ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5))) * (t{i} * {k1 + 1}) / (t{i} + {k1} * (1 - {b} + {b} * len / avg))" for i, t in enumerate(distinct))
    any_ = " OR ".join(f"t{i} > 0" for i in range(len(distinct)))
    return f"""SELECT doc_id, {parts} AS score FROM (SELECT doc_id, len(w) AS len, {tf} FROM (SELECT doc_id, {tokens("text")} AS w FROM documents)) c,
(SELECT count(*) AS n, avg(len) AS avg, {df} FROM (SELECT len(w) AS len, {tf} FROM (SELECT {tokens("text")} AS w FROM documents))) s WHERE {any_}"""


SEGMENTS = """lines AS (SELECT conv_id, turn, role AS speaker, i AS line, string_split(text, chr(10))[i] AS text FROM conversations, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
segments AS (SELECT conv_id, seq, speaker, text, seq * 4000 + CASE WHEN seq % 5 = 4 THEN 2000 ELSE 0 END AS timestamp_ms FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) - 1 AS seq FROM lines WHERE text <> ''))"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def found(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {quoted(pattern)}))"


def first_match(column: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(column, p)} THEN '{name}'" for name, p in rules) + f" ELSE {default} END"
