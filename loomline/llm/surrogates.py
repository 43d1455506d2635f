"""Personal data: keyed surrogates, in DataFrame operations only.

Found are secrets (after words like token or key, and well-known forms), e-mail and IP addresses, telephone, social
security, card (only with a valid check digit) and bank account numbers, and names after a form of address; a full
name found so is also replaced where it stands without one in the same text. Names that never stand after a form of
address are not found. A text is searched once, and only if it holds what some form needs (an at sign, a run of
digits, a title and so on); matches are written with the row, and only rows with matches are touched afterwards.

A match is cut into entities (type, canonical value). The parts of a name are entities of their own, in any place:
"Mr. A B", "Dr. A B", "A B" and "Mr. B" agree. A part's gender is what most forms of address before it as a first name
say; parts without such evidence get neutral surrogates.

Surrogates come from HMAC-SHA-256 of the entity under ``key``, which the caller keeps. They keep type and format:
digits, letters, case and script stay in their places, card check digits stay valid, address bytes stay in range. One
table holds each different entity once; a surrogate that meets another one or a real value of its type is drawn again
until all are distinct, so distinct values stay distinct and equal values stay equal over the whole corpus. Names,
e-mail and IPv4 addresses grow longer where short ones run out; if another format has no free values left, the
operator raises.

Null texts stay null; null ids are values like any other. Empty texts and texts without matches are unchanged; very
long texts are searched whole. Repeated rows get equal surrogates. Extra columns are kept, whatever their names: the
count of replacements is ``n_replaced``, with underscores appended while that name is taken. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import materialize, table, whole_row

DEMO_KEY, ATTEMPTS, WIDEN = b"a published key protects nothing", 40, 6

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET_HEAD = r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
_MALE = "Mr|Herr|M|Monsieur|Sr|Señor|Don|Г-н|Господин|Κύριος|κύριος"
_FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Doña|Г-жа|Госпожа|Κυρία|κυρία"
_NEUTRAL = "Dr|Prof"
_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? "
_HEX = "[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}[\p{L}'’\-]+(?: \p{Lu}[\p{L}'’\-]+){0,2}"
#: type -> (pattern of what stands before the value, pattern of the value); the first type that fits a match counts
FORMS: dict[str, tuple[str, str]] = {
    "secret": (_SECRET_HEAD, r"[A-Za-z0-9_\-+/]{16,}"),
    "known": ("", r"(?<![A-Za-z0-9])(?:sk-[A-Za-z0-9_\-]{16,}|gsk_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)"),
    "email": ("", r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}"),
    "ip": ("", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    "ip6": ("", rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,5}}|(?:{_HEX}:){{1,6}}:)(?![0-9A-Za-z:])"),
    "phone": ("", r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[\-.]\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4})(?![\d\-])"),
    "ssn": ("", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "card": ("", r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)"),
    "name": (_TITLE, _NAME),
}
PATTERN = "|".join(f"(?:{head}{value})" for head, value in FORMS.values())

_LATIN = "ba be bi bo da de do fa fe ga ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi".split()
_CYRILLIC = "ба бе во га да де ди ка ко ла ле ли ма ме ми на не ни па ра ре ри ро са се та те ти ва ви".split()
_GREEK = "βα γα δα δε κα κο λα λε λι μα με μι να νε νι πα ρα ρε ρι ρο σα σε τα τε τι".split()
_ENDS = {("latin", "m"): "nor rik lan ton bert mund win gar".split(), ("latin", "f"): "na lia rina tta ssa nda lena mira".split(), ("latin", "x"): "son ley ner man ford well er ton".split(), ("cyrillic", "m"): "слав мир лан тон рик дан лев мин".split(), ("cyrillic", "f"): "на лия рина та нда лена мира ся".split(), ("cyrillic", "x"): "ко енко юк ян дзе чук вич иш".split(), ("greek", "m"): "νος ρος λος τος κος δας μος νης".split(), ("greek", "f"): "να λια ρινα τα νη λενα μιρα σα".split(), ("greek", "x"): "ιδης ακης ου ας ελης άτος ίνης άς".split()}
_ALPHABETS = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz")]


def _maybe(text: Column) -> Column:
    """Whether a text holds what some form needs; cheap, and true wherever ``PATTERN`` matches."""
    titles = "|".join((_MALE, _FEMALE, _NEUTRAL)).split("|")
    needed = ["@", "sk-", "AKIA", "eyJ", "::", *[f"gh{c}_" for c in "pousr"], "gsk_", *[t + end for t in titles for end in (" ", ". ")]]
    runs = [r"[0-9][0-9 .()\-]{3,}[0-9]", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", r"[=:]\s{0,3}[\"']?[A-Za-z0-9_\-+/]{16}", f"(?:{_HEX}:){{7}}"]
    found = F.lit(False)
    for x in needed:
        found = found | text.contains(x)
    for x in runs:
        found = found | text.rlike(x)
    return found


def _pads(spark: SparkSession, key: bytes) -> DataFrame:
    """The key as one row of the two pads of HMAC. Rows, unlike literals, are in no plan, so in no log and no UI."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return F.broadcast(spark.createDataFrame([tuple(bytearray(c ^ pad for c in block) for pad in (0x36, 0x5C))], "_inner binary, _outer binary"))


def _keyed_digest(message: Column) -> Column:
    """HMAC-SHA-256 in lower-case hex, with the columns of ``_pads``."""
    return F.sha2(F.concat(F.col("_outer"), F.unhex(F.sha2(F.concat(F.col("_inner"), F.encode(message, "UTF-8")), 256))), 256)


def _number(digest: Column, at: Column) -> Column:
    """A number below 65536 from a hex digest of 64 characters, for any place."""
    return F.conv(F.substr(digest, F.pmod(at * 7, F.lit(61)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))))


def _syllable(parts: list[str], digest: Column):
    return lambda i: _pick(parts, _number(digest, i * 4 + 9))


def _luhn_sum(digits: Column) -> Column:
    """Sum for the check digit rule over a string of digits, the last not doubled."""
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(reverse, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _kind(match: Column) -> Column:
    out = F.lit("bare")  # a name without its form of address
    for kind, (head, value) in reversed(FORMS.items()):
        out = F.when(match.rlike(f"^(?:{head}{value})$"), kind).otherwise(out)
    return out


def _head(match: Column, kind: Column) -> Column:
    return F.when(kind == "secret", F.regexp_extract(match, f"^{_SECRET_HEAD}", 0)).when(kind == "name", F.regexp_extract(match, f"^{_TITLE}", 0)).otherwise("")


def _canonical(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))).when(kind.isin("secret", "known"), value).otherwise(F.lower(value))


def _draw(kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity at an attempt."""
    digest = _keyed_digest(F.concat_ws("\x1f", kind, canon, attempt.cast("string")))
    chars = F.filter(F.split(canon, ""), lambda c: c != "")

    def swap(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        out = c
        for pattern, alphabet in reversed(_ALPHABETS):
            size = len(alphabet)
            one = F.substr(F.lit(alphabet), F.pmod(n, F.lit(size)) + 1, F.lit(1))
            if alphabet[0] == "0":  # a digit other than 0 stays one: no leading zeros appear
                one = F.when(c == "0", one).otherwise(F.substr(F.lit(alphabet), F.pmod(n, F.lit(9)) + 2, F.lit(1)))
            if alphabet[0] == "a":  # hex strings stay hex
                one = F.when(canon.rlike("^[0-9a-fA-F:]+$"), F.substr(F.lit("abcdef"), F.pmod(n, F.lit(6)) + 1, F.lit(1))).otherwise(one)
            out = F.when(F.lower(c).rlike(pattern), F.when(c == F.lower(c), one).otherwise(F.upper(one))).otherwise(out)
        return out

    plain = F.array_join(F.transform(chars, swap), "")
    domain_end = F.regexp_extract(canon, r"\.\p{L}{2,}$", 0)
    wider = F.when(attempt > WIDEN, attempt.cast("string")).otherwise("")
    email = F.concat(wider, F.substr(plain, F.lit(1), F.char_length(canon) - F.char_length(domain_end)), domain_end)
    octets = F.split(canon, r"\.")
    ip = F.array_join(F.transform(octets, lambda o, i: F.when((F.length(o) == 3) | (attempt > WIDEN), F.pmod(_number(digest, i * 4), F.lit(156)) + 100).when(F.length(o) == 2, F.pmod(_number(digest, i * 4), F.lit(90)) + 10).otherwise(F.pmod(_number(digest, i * 4), F.lit(10))).cast("string")), ".")
    stem = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(plain, F.lit(2), F.char_length(canon) - 2))  # the first digit tells the card's kind
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.concat(stem, check.cast("string"))
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(plain, F.lit(3), F.lit(40)))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    name = F.lit("")
    for (letters, gender), ends in _ENDS.items():
        parts = {"latin": _LATIN, "cyrillic": _CYRILLIC, "greek": _GREEK}[letters]
        more = F.array_join(F.transform(F.sequence(F.lit(0), attempt), _syllable(parts, digest)), "")
        built = F.concat(_pick(parts, _number(digest, F.lit(1))), more, _pick(ends, _number(digest, F.lit(5))))
        name = F.when((script == letters) & (F.substr(kind, F.lit(6), F.lit(1)) == gender), built).otherwise(name)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind.startswith("name_"), name).otherwise(plain)


def _pour(surface: Column, kind: Column, made: Column) -> Column:
    """The canonical surrogate in the format and case of the value as written."""
    letters = F.filter(F.split(surface, ""), lambda c: c != "")
    fitting = F.transform(letters, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(made, F.char_length(F.regexp_replace(F.substr(surface, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")), F.lit(1))).otherwise(c))
    upper = F.when((surface == F.upper(surface)) & (surface != F.lower(surface)), F.upper(made)).otherwise(made)
    title = F.when((surface == F.upper(surface)) & (F.char_length(surface) > 1), F.upper(made)).otherwise(F.initcap(made))
    return F.when(kind.startswith("name_"), title).when(kind.isin("email", "ip", "ip6"), upper).when(kind.isin("secret", "known"), made).otherwise(F.when(kind == "iban", F.upper(F.array_join(fitting, ""))).otherwise(F.array_join(fitting, "")))


def entities(matches: DataFrame) -> DataFrame:
    """(match, head, at, kind, canon, surface) of different match strings: the entities in them, in order."""
    kind = _kind(F.col("match"))
    rows = matches.withColumn("form", kind).withColumn("head", _head(F.col("match"), F.col("form")))
    rows = rows.withColumn("value", F.substr("match", F.char_length("head") + 1, F.char_length("match")))
    digits = F.regexp_replace("value", r"\D", "")
    rows = rows.where((F.col("form") != "card") | (F.pmod(_luhn_sum(digits), F.lit(10)) == 0))
    named = F.col("form").isin("name", "bare")
    title = lambda words: F.col("head").rlike(rf"^(?:{words})\.? $").cast("int")
    parts = F.when(named, F.split("value", " ")).otherwise(F.array("value"))
    rows = rows.select("match", "head", "form", named.alias("named"), (title(_MALE) - title(_FEMALE)).alias("says"), F.size(parts).alias("of"), F.posexplode(parts).alias("at", "surface"))
    base = F.when(F.col("named"), "name").otherwise(F.col("form"))
    rows = rows.select("match", "head", "at", base.alias("base"), _canonical(base, F.col("surface")).alias("canon"), "surface", F.when(F.col("named") & (F.col("at") < F.col("of") - 1), F.col("says")).otherwise(0).alias("says"))
    genders = rows.where("says <> 0").groupBy("canon").agg(F.sum("says").alias("sum"))
    gender = F.when(F.col("sum") > 0, "name_m").when(F.col("sum") < 0, "name_f").otherwise("name_x")
    rows = rows.join(genders, "canon", "left")
    return rows.select("match", "head", "at", F.when(F.col("base") == "name", gender).otherwise(F.col("base")).alias("kind"), "canon", "surface")


def draw_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, made): one surrogate per different entity, all distinct and none a real value of its type."""
    fresh = found.select("kind", "canon").distinct().select(F.split_part("kind", F.lit("_"), F.lit(1)).alias("type"), "kind", "canon", F.lit(0).alias("attempt"))
    pads = _pads(found.sparkSession, key)
    named = materialize(fresh.crossJoin(pads).withColumn("made", _draw(F.col("kind"), F.col("canon"), F.lit(0))).drop("_inner", "_outer"), "entities")
    for _ in range(ATTEMPTS):
        first = named.groupBy("type", "made").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n"))
        real = named.select("type", F.col("canon").alias("made"), F.lit(True).alias("real"))
        bad = first.join(real, ["type", "made"], "left").where((F.col("n") > 1) | F.col("real")).select("type", "made", F.when(F.col("real"), F.lit(None)).otherwise(F.col("first.canon")).alias("stays"))
        bad = materialize(bad, "collisions")
        if not bad.take(1):
            return named.select("kind", "canon", "made")
        redo = F.coalesce("hit", F.lit(False)) & ~F.col("canon").eqNullSafe(F.col("stays"))
        again = named.join(bad.withColumn("hit", F.lit(True)), ["type", "made"], "left").withColumn("attempt", F.when(redo, F.col("attempt") + 1).otherwise(F.col("attempt")))
        again = again.crossJoin(pads).withColumn("made", F.when(redo, _draw(F.col("kind"), F.col("canon"), F.col("attempt"))).otherwise(F.col("made")))
        named = materialize(again.select("type", "kind", "canon", "attempt", "made"), "entities")
    raise RuntimeError("a format has too few free values for distinct surrogates")


def replace_personal_data(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_replaced``, the number of matches replaced."""
    names, count = docs.columns, "n_replaced"
    while count in names:
        count += "_"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    marked = materialize(docs.select(whole_row(docs), F.when(_maybe(text), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(none).alias("_found")), "marked")
    clean = marked.where(F.size("_found") == 0).select("_row.*", F.lit(0).cast("long").alias(count))

    old = F.col("_row.text").cast("string")
    full = F.array_distinct(F.filter(F.transform(F.filter("_found", lambda m: m.rlike(f"^{_TITLE}{_NAME}$")), lambda m: F.regexp_replace(m, f"^{_TITLE}", "")), lambda v: v.contains(" ")))
    bare = F.array_join(F.transform(F.reverse(F.array_sort(full)), lambda v: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), v, F.lit(r"\E(?![\p{L}\p{N}])"))), "|")
    hits = marked.where(F.size("_found") > 0).withColumn("_pattern", F.when(F.size(full) > 0, F.concat(F.lit(PATTERN + "|"), bare)))
    hits = hits.withColumn("_found", F.when(F.col("_pattern").isNull(), F.col("_found")).otherwise(F.regexp_extract_all(old, F.col("_pattern"), F.lit(0))))
    hits = materialize(hits.withColumn("_sha", F.sha2(old, 256)), "hits")

    each = hits.dropDuplicates(["_sha"]).select("_sha", F.posexplode("_found").alias("_at", "match"))
    each = materialize(each, "matches")
    found = materialize(entities(each.select("match").distinct()), "found")
    made = draw_surrogates(found, key)
    new = found.join(made, ["kind", "canon"]).withColumn("new", _pour(F.col("surface"), F.col("kind"), F.col("made")))
    swaps = materialize(new.groupBy("match", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("new")).select("match", F.concat("head", "new").alias("_new")), "swaps")
    lists = each.join(swaps, "match", "left").groupBy("_sha").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_new", "match").alias("v")))), lambda x: x["v"]).alias("_list"), F.count("_new").alias("_n"))
    rest = hits.join(materialize(lists.where("_n > 0"), "lists"), "_sha", "left")
    plain = F.split(old, F.coalesce("_pattern", F.lit(PATTERN)), -1)
    filled = F.concat(F.array_join(F.zip_with(F.slice(plain, 1, F.size("_list")), F.col("_list"), lambda a, b: F.concat(a, b)), ""), F.element_at(plain, -1))
    put = F.when(F.col("_list").isNull(), old).otherwise(filled)
    rest = rest.select(*[(put if c == "text" else F.col("_row")[c]).alias(c) for c in names], F.coalesce("_n", F.lit(0)).cast("long").alias(count))
    return clean.unionByName(rest)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting ``spark.loomline.surrogates.secret``, a name that Spark redacts; without it, a published one, for tests only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = spark.conf.get("spark.loomline.surrogates.secret", None)
    return replace_personal_data(docs, key.encode() if key else DEMO_KEY)
