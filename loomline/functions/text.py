"""Column functions over text: tokens, cleaning, flags, redaction. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
FILLERS = ["uh", "um", "ah", "hmm", "hm", "er", "erm", "like", "you know", "i mean", "basically", "actually", "so", "well", "anyway", "anyways"]
ACKNOWLEDGEMENTS = ["okay", "ok", "yeah", "yes", "right", "sure", "got it", "gotcha", "uh-huh", "uh huh", "mm-hmm", "mm hmm", "mhm", "cool", "great", "nice", "perfect", "alright", "all right"]
LINE_FILLERS = ["uh", "um", "ah", "hmm", "hm", "er", "erm", "mm", "mhm"]
QUESTION_WORDS = "what|who|when|where|why|how|can|could|would|should|is|are|do|does|did"
DECISION_WORDS = "decided|agreed|confirmed|approved|let's go with|we'll do|going with"
ACTION_WORDS = "will|going to|need to|should|must|action item|todo|follow up|follow-up"
DEADLINE_WORDS = "by|before|deadline|next week|tomorrow|end of day|eod"
RISK_WORDS = "risk|blocker|blocked|concern|issue|problem|delay"
SECRET_FORMS = [r"(?i)Bearer\s+[A-Za-z0-9._~+/=:-]{12,}", r"(?i)sk-[A-Za-z0-9]{20,}", r"(?i)gsk_[A-Za-z0-9]{20,}", r"(?i)dg_[A-Za-z0-9]{20,}", r"[A-Za-z0-9_-]{24,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{20,}"]
LOG_SECRET_FORMS = [r"(?i)sk-[A-Za-z0-9]{20,}", r"(?i)gsk_[A-Za-z0-9]{20,}", r"(?i)dg_[A-Za-z0-9]{20,}", r"AIza[A-Za-z0-9_-]{20,}", r"sk-ant-api03-[A-Za-z0-9_-]{20,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"]
REDACTED = "[REDACTED]"

#: ASCII word borders: Java's own would count letters like é as word characters.
_BEGIN, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def word(pattern: str) -> str:
    """The pattern as whole words, ASCII borders, any case."""
    return f"(?i){_BEGIN}(?:{pattern}){_END}"


def tokens(text: Column) -> Column:
    """Lexical tokens: lower case, possessives and apostrophes off, runs of [a-z0-9-] of three characters or more.

    Runs are matched rather than what is between them replaced: that takes a third of the time.
    """
    lower = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]s" + _END, ""), "['’]", "")
    return F.regexp_extract_all(lower, F.lit("[a-z0-9-]{3,}"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """About four characters a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def clean_spoken(text: Column) -> Column:
    """Repeated words, fillers and acknowledgements dropped, punctuation squeezed."""
    once = F.regexp_replace(F.trim(text), rf"(?i){_BEGIN}(\w+)(\s+\1)+{_END}", "$1")
    bare = lambda w: F.regexp_replace(F.lower(w), r"[.,!?;:]", "")
    kept = F.filter(F.split(once, r"\s+"), lambda w: ~bare(w).isin(FILLERS + ACKNOWLEDGEMENTS))
    joined = F.regexp_replace(F.trim(F.array_join(kept, " ")), r"\s+([.,!?;:])", "$1")
    return F.regexp_replace(F.regexp_replace(joined, r"([.,!?;:])+", "$1"), r"\s+", " ")


def clean_line(text: Column) -> Column:
    """Three or more repeats, hesitations and "you know" dropped from a line."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i){_BEGIN}(\w+)(\s+\1{_END}){{2,}}", "$1")
    out = F.regexp_replace(out, rf"(?i){_BEGIN}(uh|um|ah|hmm|er|erm){_END}[,.]?\s*", "")
    out = F.regexp_replace(out, rf"(?i){_BEGIN}(you know|i mean){_END}[,.]?\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\s+([.,!?;:])", "$1"))


def strip_edge_fillers(text: Column) -> Column:
    """Fillers dropped at the ends of a text only, so that words with content survive inside."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    filler = lambda w: F.regexp_replace(F.lower(w), r"[.,!?;:]", "").isin(FILLERS + ACKNOWLEDGEMENTS)
    solid = F.filter(F.transform(words, lambda w, i: F.when(~filler(w), i)), lambda i: i.isNotNull())
    return F.when(F.size(solid) > 0, F.array_join(F.slice(words, F.array_min(solid) + 1, F.array_max(solid) - F.array_min(solid) + 1), " ")).otherwise("")


def is_interim_noise(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[\s.,!?;:]", "")
    return (F.length(bare) <= 1) | bare.isin(LINE_FILLERS)


def is_question(text: Column) -> Column:
    return text.rlike(r"\?$") | text.rlike(rf"(?i)^(?:{QUESTION_WORDS}){_END}")


def is_decision(text: Column) -> Column:
    return text.rlike(word(DECISION_WORDS))


def is_action(text: Column) -> Column:
    return text.rlike(word(ACTION_WORDS)) | text.rlike(word(DEADLINE_WORDS))


def is_risk(text: Column) -> Column:
    return text.rlike(word(RISK_WORDS))


def speaker_name(speaker: Column) -> Column:
    """Display name of a raw speaker label."""
    lower = F.lower(speaker)
    return F.when(lower.isin("interviewer", "speaker"), "Speaker").when(lower.isin("user", "me"), "You").when(lower == "assistant", "Assistant").otherwise(speaker)


def speaker_id(speaker: Column) -> Column:
    """Stable id of a raw speaker label."""
    raw = F.lower(F.trim(F.coalesce(speaker, F.lit(""))))
    slug = F.regexp_replace(F.regexp_replace(raw, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    known = F.when(raw.isin("assistant", "ai"), "assistant").when(raw.isin("system", "audio"), "speaker_1").when(raw.isin("", "unknown", "speaker"), "unknown")
    return known.when(raw.isin("user", "me"), "me").when(raw.isin("interviewer", "them", "other"), "speaker_1").otherwise(F.when(slug == "", "speaker").otherwise(slug))


def redact(text: Column, forms: list[str] = SECRET_FORMS) -> Column:
    """Secrets of known forms replaced; the scheme word of a bearer token goes with it."""
    for form in forms:
        text = F.regexp_replace(text, form, REDACTED)
    return text


def sanitise_url(url: Column) -> Column:
    """scheme://host/path without query and fragment; ids, addresses and opaque tokens masked."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1))
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1), r"^www\.", "")
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)

    def opaque(s: Column) -> Column:
        run = F.regexp_extract(s, r"[A-Za-z0-9]{16,}", 0)
        return (F.length(run) >= 16) & (run.rlike(r"\d") | (run.rlike("[A-Z]") & run.rlike("[a-z]")) | (F.length(run) > 20))

    labels = F.split(host, r"\.")
    clean_host = F.array_join(F.transform(labels, lambda x, i: F.when((i < F.size(labels) - 2) & opaque(x), ":sub").otherwise(x)), ".")
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    masked = lambda s: F.when(s.contains("@") & s.contains("."), ":email").when(s.rlike(uuid) | s.rlike(r"^\d{6,}$"), ":id").when(opaque(s), ":token").otherwise(s)
    clean_path = F.regexp_replace(F.array_join(F.transform(F.split(path, "/"), masked), "/"), "/{2,}", "/")
    return F.when(host != "", F.concat(F.when(scheme.isin("http", "https"), scheme).otherwise("https"), F.lit("://"), clean_host, clean_path))


def overlap_words(text: Column, stop: str) -> Column:
    """Different words of a text for similarity: lower case, letters and digits, stop words off."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*[F.lit(w) for w in stop.split("|")]))


def text_key(text: Column) -> Column:
    """Identity of a passage: a digest of its text, trimmed, in lower case, blanks collapsed."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 256), 1, 16)


def strip_markup(html: Column) -> Column:
    """Text of a page without script, style, noscript, template and tags; blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
