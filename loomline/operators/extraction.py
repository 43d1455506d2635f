"""Extraction that needs a small parser per text: quantities, front matter, relations, document chunks.

Each helper takes one text; Spark spreads the texts, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from loomline.operators import chunks
from loomline.operators.work import flat_mapped

# Number words, magnitudes, labels, predicates and cues that results depend on.
SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}
SUFFIXES = {"k": 1000, "m": 1_000_000, "mm": 1_000_000, "b": 1_000_000_000, "bn": 1_000_000_000}
LABELS = {
    "title": ["Title"], "subtitle": ["Subtitle"], "author": ["Author", "Authors", "Candidate", "Student", "Written by", "By"], "degree_program": ["Degree programme", "Degree program", "Degree", "Programme", "Program"], "major": ["Major", "Specialisation", "Specialization", "Track"],
    "institution": ["Institution", "University", "School", "Faculty"], "department": ["Department", "Dept"], "supervisor": ["Supervisors", "Supervisor", "Examiner", "Examiners"], "advisor": ["Advisors", "Advisor", "Co-advisors", "Co-advisor", "Instructors", "Instructor"],
    "collaborator": ["Collaborative partner", "Collaborative partners", "Industry partner", "Partner", "Collaborators", "Collaborator"], "date": ["Date", "Submitted", "Submission date", "Defense date"], "page_count": ["Number of pages", "Pages", "Page count", "Total pages"], "language": ["Language"], "keywords": ["Keywords", "Keyword", "Key words", "Index terms"],
}
LIST_PROPERTIES = {"supervisor", "advisor", "collaborator", "keywords"}
FRONT_PAGES = 6
RELATIONS = [
    ("improves_over", "high", r"\bimproves?\s+(?:on|over|upon)\b"), ("extends", "high", r"\bextends?\b|\ban improved (?:version|variant) of\b|\bbuilt on top of\b"), ("based_on", "high", r"\bbased on\b|\bbuilt on\b|\bdeveloped from\b"), ("implements", "medium", r"\bimplements?\b|\bimplemented (?:using|with)\b"),
    ("uses", "low", r"\buses?\b|\butiliz(?:es?|ing)\b|\bleverages?\b|\bemploys?\b|\bintegrat(?:es?|ing)\b|\bcombin(?:es?|ing)\b(?:.{0,20}\bwith\b)?"), ("is_part_of", "medium", r"\bis (?:a )?(?:part|component|module) of\b|\bwithin the\b"),
    ("evaluates", "low", r"\bevaluat(?:es?|ing)\b|\bbenchmarks?\b(?!\s+result)"), ("contrasts_with", "medium", r"\bcompared (?:to|with)\b|\bunlike\b|\bin contrast to\b|\bversus\b|\bvs\.?\b"), ("cites", "low", r"\[\d+\]"),
]
NEGATION = r"\b(?:unrelated to|not related to|no relation to|nothing to do with|no connection to|not connected to|in no way connected|bears no relationship to|has no bearing on|should not be confused with|independent of|separate from|distinct from|different from|as opposed to|in contrast to|in contrast with|compared to|in comparison to|far removed from|excluding|except for|rather than|instead of|not\b|unlike|without)\b"


def quantities(text: str) -> list[str]:
    """Digit strings of all quantities in a lower-case text, written in digits, with magnitudes or in words."""
    plain = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", re.sub(r"(?<=\d),(?=\d{3},)", "", text))
    out = [str(round(float(m[1]) * SUFFIXES[m[2]])) for m in re.finditer(r"(\d+(?:\.\d+)?)\s*(mm|bn|[kmb])\b", plain)]
    out += re.findall(r"\b\d{4,}\b", plain)
    whole, group, open_ = 0.0, 0.0, False
    for word in [*re.sub(r"[^a-z0-9.\s-]", " ", plain).split(), ""]:
        if word == "and" and open_:
            continue
        if word in SMALL or word in TENS:
            group, open_ = group + SMALL.get(word, 0) + TENS.get(word, 0), True
        elif word == "hundred":
            group, open_ = (group or 1) * 100, True
        elif word in SCALES:
            whole, group, open_ = whole + (group or 1) * SCALES[word], 0.0, True
        else:
            if open_ and whole + group > 0:
                out.append(f"{whole + group:g}" if (whole + group) % 1 else str(int(whole + group)))
            number = re.fullmatch(r"\d+(?:\.\d+)?", word)
            whole, group, open_ = 0.0, float(word) if number else 0.0, bool(number)
    return out


def lexical_tokens(text: str) -> list[str]:
    """Tokens of three characters or more, then the parts of hyphenated ones, then quantities in digits, each once more."""
    lower = text.lower()
    base = [w for w in re.sub(r"[^a-z0-9\s-]", " ", re.sub("['’]", "", re.sub(r"['’]s\b", "", lower, flags=re.A))).split() if len(w) > 2]
    have, out = set(base), list(base)
    for extra in [*(p for w in base if "-" in w for p in w.split("-")), *quantities(lower)]:
        if len(extra) > 2 and extra not in have:
            have.add(extra)
            out.append(extra)
    return out


_LABELS = sorted(((label, name) for name, labels in LABELS.items() for label in labels), key=lambda x: -len(x[0]))
_LABEL = re.compile(r"\b(" + "|".join(re.escape(label) for label, _ in _LABELS) + r")\b")


def front_matter(text: str) -> list[tuple[str, str, list[str], int | None]]:
    """(property, value, items, page): the first value of each property, on lines that begin with a label; a line may
    hold several labels. Pages after the sixth don't count."""
    names, page, found = dict(_LABELS), None, {}
    for raw in re.split(r"\r?\n", text):
        if m := re.fullmatch(r"\s*\[Page\s+(\d+)\]\s*", raw):
            page = int(m[1])
            continue
        if page is not None and page > FRONT_PAGES:
            break
        line = " ".join(raw.split())
        marks = list(_LABEL.finditer(line))
        if not marks or marks[0].start():
            continue
        bounds = [marks[0]]
        for m in marks[1:]:  # a label right after another is its value
            if m.start() > bounds[-1].end() + 1:
                bounds.append(m)
        for m, end in zip(bounds, [*(b.start() for b in bounds[1:]), len(line)]):
            name, value = names[m[1]], line[m.end() : end].strip(" :")
            if value and name not in found:
                items = [x.strip() for x in re.split(r"\s*(?:,|;|\band\b|&)\s*", value) if x.strip()] if name in LIST_PROPERTIES else []
                found[name] = (name, value, items, page)
    return list(found.values())


def relations(subject: str, body: str, entities: list[str]) -> list[tuple[str, str, str]]:
    """(predicate, object, confidence): one per sentence that names the subject and another entity.

    The object is the nearest entity after the predicate, or else the nearest at all, outside brackets and not right
    before one. A negation between subject and object voids the sentence unless it is the predicate itself.
    """
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", body):
        own = re.search(rf"\b{re.escape(subject)}\b", sentence, re.I)
        aside = [m.span() for m in re.finditer(r"\([^()]*\)|\[[^\[\]]*\]", sentence)]
        named = [(m.start(), e) for e in entities if e.lower() != subject.lower() for m in re.finditer(rf"\b{re.escape(e)}\b", sentence, re.I)]
        named = sorted((at, e) for at, e in named if not any(a <= at < b for a, b in aside) and not re.match(r"\s*[(\[]", sentence[at + len(e) : at + len(e) + 3]))
        if not own or not named:
            continue
        no = re.search(NEGATION, sentence, re.I)
        for predicate, sure, pattern in RELATIONS:
            hit = re.search(pattern, sentence, 0 if predicate == "cites" else re.I)
            if not hit:
                continue
            at, name = next(((a, e) for a, e in named if a > hit.start()), None) or min(named, key=lambda x: abs(x[0] - hit.start()))
            between = no and min(own.start(), at) <= no.start() <= max(own.start(), at)
            if between and not (no.start() < hit.end() and no.end() > hit.start()):
                continue
            out.append((predicate, name, sure))
            break
    return out


def document_chunks(text: str) -> list[tuple[str, int | None, int | None, str]]:
    """(kind, start, end, text): rows of a table, the table of contents, then sentence windows of each page.

    Offsets are those of the window in the text, where it stands there as it is.
    """
    if rows := chunks.table_rows(text):
        return [("table", None, None, "\n".join(rows[at : at + 10])) for at in range(0, len(rows), 10)]
    out: list[tuple[str, int | None, int | None, str]] = []
    contents = [line.strip() for line in text.split("\n") if re.search(r"\.{4,}\s*\d+\s*$", line)]
    if contents:
        out.append(("toc", None, None, "[Table of Contents]\n" + "\n".join(contents)))
    at = 0
    parts = re.split(r"\[Page (\d+)\]", text)
    for page, body in [("1", parts[0]), *zip(parts[1::2], parts[2::2])]:
        body = "\n".join(line for line in body.split("\n") if not re.search(r"\.{4,}\s*\d+\s*$", line))
        for window in chunks.by_words(body) if body.strip() else []:
            place = text.find(window, at)
            if place >= 0:
                at = place + 1
            out.append(("text" if len(parts) == 1 else f"page {page}", place if place >= 0 else None, place + len(window) if place >= 0 else None, window))
    return out


def flat_map(docs: DataFrame, one: Callable[[dict], list[tuple]], key: str, schema: str) -> DataFrame:
    """(key, place, columns of ``schema``): what ``one`` finds in each row, in order."""
    return flat_mapped(docs, lambda row: [(row[key], n, *x) for n, x in enumerate(one(row))], f"{key} long, place int, {schema}")
