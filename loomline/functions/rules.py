"""Rule lists over questions and transcripts: ordered patterns, weighted cues, answerability. Built-in expressions only.

Patterns are written once, with ``\\b`` for ASCII word borders; ``borders`` puts them in a form that no letter outside
ASCII changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "[A-Za-z0-9_]"
_B = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# Patterns, weights and word lists that results depend on.
DOCUMENT_WORDS = r"(?i)\b(?:file|document|notes?|pdf|according to|uploaded|that|this|my)\b"
MEETING = r"(?i)\b(?:meeting|meetings|call|conversation|discuss(?:ed|ion)?|talk(?:ed|ing)?|said|mentioned|decided|decision|agreed|action items?|follow[- ]?up|next steps?|speaker|transcript)\b|\bwhat did (?:we|he|she|they|[a-z][a-z0-9_-]*) say\b"
CONVERSATION = r"(?i)^(?:what did we|what have we|what were we|what was discussed|what did i say|what did you say|what did they say|what happened|what did we discuss|what was our discussion|what did we decide)\b|\b(?:five minutes ago|a few minutes ago|just now|earlier today|earlier|previously|in our meeting|in the meeting|on the call|during the call)\b"
PERSONAL = r"(?i)\b(?:my|mine|personal|notes?|notebook|saved|resume|cv|curriculum vitae|my files?|personal files?|project notes?|projects?|find my)\b"
KNOWLEDGE = r"(?i)\b(?:knowledge(?:\s+file)?|verified (?:fact|card)s?)\b"
REFERENCE_FILES = r"(?i)\b(?:annual report|quarterly report|report|reference file|reference files|uploaded document|uploaded file|document|documents|paper|specification|specs|policy|manual|handbook|presentation|slides|dataset|research|whitepaper)\b"
STUB = r"(?i)^(?:please\s+)?(?:elaborate|continue|expand|go (?:on|deeper)|tell me more|more detail)\b"
REFERENTIAL_START = r"(?i)^(?:and\s+)?(?:how|why|when|where|what|who|which|can|could|would|does|did|is|are|was|were|tell|explain|expand|elaborate|go)\b"
REFERENTIAL_WORD = r"(?i)\b(?:it|this|that|those|they|them|also|then|so|more|further|change|changed|different|difference|why|how|elaborate|continue|deeper)\b"
CHITCHAT = r"(?i)^$|^(?:please\s+)?(?:write|draft|compose|create|make|generate|invent|brainstorm)\b|^(?:tell me a joke|say something funny)\b|^(?:hi|hello|hey|thanks|thank you|good (?:morning|afternoon|evening|night)|ok|okay)\b[.!?]*$"
QUESTION_TYPES = [
    ("identity", r"\b(your (full |first |last )?name|who are you|what'?s your name|what is your name)\b|\b(introduce yourself|introducing yourself|tell me about yourself|describe yourself|about yourself)\b|\bself[- ]?(introduc(tion|e)|intro)\b|\b(give|giving|provide|share|start (us |me |the team )?off with)\b.{0,30}\b(a |an )?(quick |brief |short |little )?(introduction|intro)\b|\b(who (are|is) (the|this) (candidate|person|interviewee))\b"),
    ("negotiation", r"\b(salary|compensation|comp|pay|package|ctc|equity|stock|bonus|offer|expectations? (for|on) (pay|salary|comp)|how much (do|are) you (expect|looking)|what are you (expecting|looking for)|notice period|joining date)\b"),
    ("jd_alignment", r"\b(good fit|right fit|why (should we|do you want|are you interested)|fit for (this|the) (role|position|job)|why this (role|company|position)|what makes you|why you)\b"),
    ("behavioral", r"\b(tell me about a time|describe a (situation|time)|give me an example of a time|when have you|a time when you|walk me through a (time|situation)|how did you handle|conflict|challenge you faced)\b"),
    ("profile_detail", r"\b(your )?(projects?|side projects?|experience|work history|background|skills?|tech stack|education|degree|studied|university|college|achievements?|certifications?|what have you (built|worked on|done))\b"),
    ("technical", r"\b(implement|write (code|a function|a program)|algorithm|data structure|system design|how does .* work|explain (how|the)|difference between|what is (a|an|the)|optimi[sz]e|debug|complexity)\b"),
]
CARD_TYPES = [
    ("metadata", r"(?i)\b(who\s+(?:is|wrote|are)\s+the\s+(?:author|writer)|author\s+of\s+the|title\s+of\s+the\s+(?:thesis|paper|document|report|dissertation)|full\s+title|(?:name|list)\s+(?:an?\s+|the\s+|one\s+|two\s+)?(?:advisors?|supervisors?|examiners?)|advisors?\s+listed|supervisors?\s+listed|(?:what|which)\s+(?:date|language|institution|university|degree|department|keywords?)\s+(?:is|are|does|listed|written)|number\s+of\s+pages|how\s+many\s+pages|(?:what|which)\s+language\s+(?:is|was)\s+the\s+(?:thesis|paper|document|report|it)|keywords?\s+(?:listed|for\s+the))"),
    ("main_topic", r"(?i)\b(main topic|what is .*(thesis|paper|document|project) about|overview)\b"),
    ("summary", r"(?i)\b(simple words|summari[sz]e|explain .* (simply|briefly)|tl;?dr)\b"),
    ("problem_statement", r"(?i)\b(problem (is|does|are).*(solv|address)|what problem)\b"),
    ("research_questions", r"(?i)\b(research questions?|RQ\d)\b"),
    ("objectives", r"(?i)\b(objectives?|goals?|aims?|phases?)\b"),
    ("comparison", r"(?i)\b(difference|different from|compare|versus|vs\.?|better than)\b"),
    ("method", r"(?i)\b(how (is|does|was)|method|approach|implementation|technique)\b"),
    ("result", r"(?i)\b(result|finding|benchmark|evaluation|success rate|outcome)\b"),
    ("conclusion", r"(?i)\b(conclusion|future work|limitation|takeaway)\b"),
    ("definition", r"(?i)\b(what (is|are|does)\b.*\bmean|define|definition of)\b"),
]
FOLLOW_UP = r"(?i)\b(it|that|this|those|these|the(?:m|y))\b.{0,20}$|^(and|also|what about|tell me more)\b"
ENTITY = r"\b(?:[A-Z][a-z0-9]+(?:[-\s][A-Z][A-Za-z0-9]+){1,3}|[A-Z][a-zA-Z]*[A-Z][a-zA-Z0-9-]*|[A-Z]{2,6})\b"
PAY = r"(?i)\b\d{2,3}\s?k\b|\b\d{1,3}\s?(?:lpa|lakh|lakhs)\b|[$£€]\s?\d|\b\d{3,}\s?(?:per|/)\s?(?:year|yr|annum|month)\b|\b(?:base salary|expected (?:salary|comp|ctc|package)|total comp(?:ensation)?|equity grant|rsus?|signing bonus|ctc)\b"
DENIED_VERBS = r"(?i)\b(insert|update|delete|drop|alter|create|replace|attach|detach|pragma|vacuum|reindex|truncate)\b"
MODE_CUES = [
    ("sales", 2, r"(?i)\b(pricing|price|quote|discount)\b"), ("sales", 2, r"(?i)\b(demo|trial|pilot|poc|proof of concept)\b"), ("sales", 2, r"(?i)\b(budget|procurement|contract|proposal|sow)\b"), ("sales", 1, r"(?i)\b(objection|competitor|roi|use case|stakeholder)\b"), ("sales", 1, r"(?i)\b(close|deal|renewal|upsell|expansion)\b"),
    ("recruiting", 2, r"(?i)\b(candidate|applicant|resume|cv|portfolio)\b"), ("recruiting", 1, r"(?i)\b(role|position|opening|req|hiring)\b"), ("recruiting", 2, r"(?i)\b(compensation|salary|notice period|start date|relocat)\b"), ("recruiting", 1, r"(?i)\b(screen|interview stage|reference check|offer)\b"), ("recruiting", 1, r"(?i)\b(years of experience|background|strengths|concerns)\b"),
    ("technical-interview", 2, r"(?i)\b(algorithm|complexity|big o|o\(n\)|time complexity)\b"), ("technical-interview", 2, r"(?i)\b(leetcode|coding|whiteboard|implement|function|array|hash map|linked list)\b"), ("technical-interview", 2, r"(?i)\b(system design|scal(e|ability)|throughput|latency|database schema)\b"), ("technical-interview", 1, r"(?i)\b(edge case|test case|brute force|optimi[sz]e|refactor)\b"),
    ("lecture", 2, r"(?i)\b(lecture|chapter|syllabus|exam|quiz|homework|assignment)\b"), ("lecture", 2, r"(?i)\b(theorem|formula|equation|definition|proof|derivation)\b"), ("lecture", 2, r"(?i)\b(professor|instructor|today we'?ll cover|in this class|textbook)\b"), ("lecture", 1, r"(?i)\b(memorize|study|concept|example problem)\b"),
    ("team-meet", 2, r"(?i)\b(sprint|standup|stand-up|backlog|roadmap|retro|retrospective)\b"), ("team-meet", 2, r"(?i)\b(blocker|blocked|dependency|ticket|jira|pull request|deploy|release)\b"), ("team-meet", 1, r"(?i)\b(action item|owner|next step|status update|since last sync)\b"), ("team-meet", 1, r"(?i)\b(team|we shipped|in progress|on track|at risk)\b"),
    ("looking-for-work", 2, r"(?i)\b(tell me about yourself|why do you want|your experience|walk me through)\b"), ("looking-for-work", 1, r"(?i)\b(this role|the team|the company|the position|interview process)\b"), ("looking-for-work", 2, r"(?i)\b(my background|i worked on|i led|i built|my strengths)\b"),
]
MODES = ["sales", "recruiting", "team-meet", "looking-for-work", "technical-interview", "lecture"]
TITLE_CUES = [("sales", 3, r"(?i)\b(sales|demo|discovery|pipeline|prospect)\b"), ("recruiting", 2, r"(?i)\b(interview|screen|candidate|recruit)\b"), ("team-meet", 3, r"(?i)\b(standup|stand-up|sprint|sync|retro|planning|1:1|one on one|team)\b"), ("lecture", 3, r"(?i)\b(lecture|class|seminar|course|tutorial)\b"), ("technical-interview", 3, r"(?i)\b(coding|technical|system design|whiteboard)\b")]
DEFINITION = r"([A-Z][a-zA-Z0-9 +./-]{2,40}?)\s+(?:is|are|refers to|means|is defined as|is called|can be defined as)\s+([^.!?]{8,200})[.!?]"
IMPORTANT = r"(?i)\b(important|note that|remember|key (point|idea|concept)|crucial|must|always|never|the main|fundamental|essential|exam|will be tested)\b"
EXAMPLE = r"(?i)\b(for example|for instance|e\.g\.|such as|consider|let'?s say|imagine|suppose)\b"
TONES = {
    "technical": (2, 5, [r"(?i)\b(implement|architecture|api|function|component|module|database|algorithm)\b", r"(?i)\b(async|await|promise|callback)\b"]),
    "formal": (1, 3, [r"(?i)\b(therefore|consequently|furthermore|moreover|regarding)\b", r"(?i)\b(I would recommend|It is important to note|As mentioned previously)\b"]),
    "casual": (1, 3, [r"(?i)\b(so basically|you know|pretty much|kind of|sort of)\b", r"(?i)\b(honestly|actually|literally)\b"]),
    "conversational": (1, 3, [r"(?i)\b(I think|In my experience|I've found|What I usually do)\b", r"(?i)\b(good question|let me|I'd say)\b"]),
}
SIMILARITY_STOP = """a an the is are was were be been being am do does did have has had having what which who whom whose when where why how can could would should will shall may
might must i me my mine we us our ours you your yours he him his she her hers it its they them their theirs and or but not no so if then than that this these those there here of in on at to for
with from by as some any about please tell give let lets""".split()


def borders(pattern: str) -> str:
    return pattern.replace(r"\b", _B)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(borders(pattern))


def found(text: Column, pattern: str) -> Column:
    """How often the pattern occurs."""
    return F.regexp_count(text, F.lit(borders(pattern)))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The name of the first rule whose pattern is found."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(matches(text, pattern), name).otherwise(out)
    return out


def question_type(question: Column) -> Column:
    return first_match(F.lower(question), QUESTION_TYPES, "general")


def card_question_type(question: Column) -> Column:
    """Type of a question to a pack of cards; short follow-ups first, entity lookups last."""
    words = F.size(F.split(F.trim(question), r"\s+"))
    kind = first_match(question, CARD_TYPES, None)
    other = F.when(F.size(target_entities(question)) > 0, "entity_lookup").otherwise("unknown")
    return F.when(F.trim(question) == "", "unknown").when(matches(question, FOLLOW_UP) & (words <= 6), "follow_up").otherwise(F.coalesce(kind, other))


def target_entities(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit(borders(ENTITY)), F.lit(0)))


def expansions(question: Column) -> Column:
    """Variants of a query: document words off, known abbreviations spelled out."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(question, borders(DOCUMENT_WORDS), " "), r"\s+", " "))
    also = lambda pattern, tail: F.when(matches(F.lower(clean), pattern), F.concat(clean, F.lit(tail)))
    oop = r"\b(?:oop|o\.o\.p\.|object[- ]oriented)\b"
    every = F.array(clean, also(oop, " object oriented programming"), also(oop, " OOP"), also(r"\bacid\b", " atomicity consistency isolation durability"), also(r"\bnormalization\b", " normal forms functional dependency"))
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (v != "")))


def source_family(question: Column) -> Column:
    """Which sources a question itself names, null if none."""
    return F.when(matches(question, MEETING) | matches(question, CONVERSATION), "meeting").when(matches(question, PERSONAL), "personal").when(matches(question, KNOWLEDGE), "knowledge").when(matches(question, REFERENCE_FILES), "mode")


def referential(question: Column) -> Column:
    return matches(question, STUB) | (matches(question, REFERENTIAL_START) & matches(question, REFERENTIAL_WORD))


def query_plan(question: Column, previous: Column) -> Column:
    """struct(reason, retrieval): the source family, inherited by follow-ups from the question before, and retrieve or skip."""
    own = source_family(question)
    before = F.when(matches(previous, MEETING), "meeting").when(matches(previous, PERSONAL), "personal").when(matches(previous, KNOWLEDGE), "knowledge").when(matches(previous, REFERENCE_FILES), "mode")
    follows = referential(question) & before.isNotNull()
    reason = F.coalesce(own, F.when(follows, "follow_up").when(referential(question), "conversation").otherwise("default"))
    named = matches(question, MEETING) | matches(question, PERSONAL) | matches(question, REFERENCE_FILES) | matches(question, KNOWLEDGE)
    retrieve = named | (~matches(question, CHITCHAT) & (reason.isin("meeting", "personal", "knowledge", "mode", "follow_up")))
    return F.struct(reason.alias("reason"), F.when(retrieve, "retrieve").otherwise("skip").alias("retrieval"))


def read_only_select(statement: Column) -> Column:
    """One statement that begins with select or with and holds no verb that changes data; comments don't count."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(statement, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "))
    one = F.regexp_replace(bare, r";\s*$", "")
    return (bare != "") & ~one.contains(";") & matches(F.lower(one), r"^(select|with)\b") & ~matches(one, DENIED_VERBS)


def values_equal(a: Column, b: Column) -> Column:
    """Equality of values in text form: numbers by value, booleans in any case, all else as written; null equals null."""
    number = lambda v: F.when(F.trim(v).rlike(r"^-?\d+(\.\d+)?$"), F.trim(v).cast("double"))
    flag = lambda v: F.when(F.lower(v).isin("true", "false"), F.lower(v))
    return F.when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b)).when(flag(a).isNotNull() & flag(b).isNotNull(), flag(a) == flag(b)).otherwise(a.eqNullSafe(b))


def answerability(text: Column, shape: Column, entities: list[str]) -> Column:
    """How well a passage fits a question of a shape that names entities; between -0.3 and 0.8."""
    lower = F.lower(text)
    hits = sum((lower.contains(e.lower()).cast("int") for e in entities if len(e) >= 3), F.lit(0))
    numeric = matches(text, r"\b\d")
    defines = matches(text, r"(?i)\b(is|are|refers to|represents|is defined as|can be understood as|consists of)\b")
    lists = matches(text, r"(?i)\b(RQ\d|research question \d|first|second|third|fourth|phase|stage|step|objective|objects?|models?)\b") | text.rlike(r"(^|\n)\s*([-*•]|\d+[.)])\s+") | (F.regexp_count(text, F.lit(";")) >= 2)
    generic = matches(F.left(text, F.lit(220)), r"(?i)\b(abstract|introduction|overview|background|methodology|chapter outlines|this thesis is organized|summary)\b")
    score = F.when(hits > 0, F.least(F.lit(0.25), hits * 0.08)).otherwise(0.0)
    score = score + F.when((shape == "definitional_answer") & defines, 0.35).otherwise(0.0) + F.when((shape == "list_answer") & lists, 0.35).otherwise(0.0)
    score = score + F.when((shape == "exact_numeric_answer") & numeric, 0.35).otherwise(0.0) + F.when((shape == "document_followup_answer") & ((hits > 0) | numeric), 0.2).otherwise(0.0)
    score = score - F.when(generic & (shape != "broad_overview"), 0.18).otherwise(0.0) - F.when((shape == "document_absent_fact_refusal") & (hits == 0) & ~numeric, 0.1).otherwise(0.0)
    return F.struct(F.greatest(F.lit(-0.3), F.least(F.lit(0.8), score)).alias("score"), (hits > 0).alias("entity"), numeric.alias("numeric"), lists.alias("lists"), defines.alias("defines"))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def question_similarity(early: Column, final: Column) -> Column:
    """How alike an early form of a question and its final form are.

    The greater of Jaccard and nine tenths of the containment of the early words. Capped at the same figure of the
    content words and at 0.6 where both hold a content word of three letters or more that the other lacks, and at the
    figure of the content words where that is below 0.6.
    """

    def blend(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        union = F.size(a) + F.size(b) - both
        return F.when(union == 0, 1.0).otherwise(F.greatest(both / F.greatest(union, F.lit(1)), F.when(F.size(a) > 0, 0.9 * both / F.greatest(F.size(a), F.lit(1))).otherwise(0.0)))

    stop = F.array(*[F.lit(w) for w in SIMILARITY_STOP])
    a, b = words_of(early), words_of(final)
    ca, cb = F.array_except(a, stop), F.array_except(b, stop)
    raw, content = blend(a, b), blend(ca, cb)
    own = lambda x, y: F.exists(F.array_except(x, y), lambda w: F.length(w) >= 3)
    capped = F.when(own(ca, cb) & own(cb, ca), F.least(raw, content, F.lit(0.6))).when(content < 0.6, F.least(raw, content)).otherwise(raw)
    return F.when((F.size(ca) == 0) | (F.size(cb) == 0), raw).otherwise(capped)


def hash_31(text: Column) -> Column:
    """Identity of a passage: polynomial hash with factor 31 in 32 bits, of 4,000 characters, then of the length."""
    norm = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    step = lambda h, v: ((h * 31 + v) % (1 << 32)).cast("long")
    chars = F.filter(F.split(F.left(norm, F.lit(4000)), ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: step(h, F.ascii(c)))
    return F.concat(F.lit("t_"), F.lower(F.hex(step(h, F.length(norm)))))


def canonical_json(names: list[str]) -> Column:
    """The columns as JSON with sorted keys and nulls written out."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def grounding(body: Column, source: Column, words) -> Column:
    """Share of the body's different words that stand in the source; 0 for a body without words."""
    own, lower = F.array_distinct(words(body)), F.lower(source)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda w: F.contains(lower, w))) / F.greatest(F.size(own), F.lit(1)).cast("double"))

# What a question may begin with, and words that no section is looked up by.
CONVERSATIONAL_OPENING = r"(?i)^\s*((hey|so|well|anyway|quick question)[,:]?\s+)*((do you (happen to )?know|can you tell me|could you tell me|would you know|i('m| am) curious|i was wondering|i('d| would) like to know)[,:]?\s+)(?=(how|what|which|where|when|why)\b)"
SECTION_STOPWORDS = (
    "what which where when how why who whom used use using uses was were are is the for and with this that these those does did "
    "has have had can could would should about role main project thesis paper work study perform many much research"
).split()

# How a line names an action, who does it, until when; and how much of a card its source must hold.
ACTION_LINES = [
    r"(?i)\b(?:i|we|you|he|she|they|[A-Z][a-z]+)\s+(?:will|should|need to|needs to|must|can|could)\s+(.+?)(?:\s+(?:by|before|on|after)\s+([^.!?]+))?[.!?]?$",
    r"(?i)\b(?:action|todo|follow up):\s*(.+?)(?:\s+(?:by|before|on|after)\s+([^.!?]+))?[.!?]?$",
    r"(?i)\b(?:send|share|schedule|book|prepare|review|follow up|circle back|introduce|email)\s+(.+?)(?:\s+(?:by|before|on|after)\s+([^.!?]+))?[.!?]?$",
]
ACTION_OWNER = r"\b(I|we|you|he|she|they|[A-Z][a-z]+)\s+(?:will|should|need to|needs to|must|can|could)\b"
ACTION_DEADLINE = r"(?i)\b(?:by|before|on|after)\s+([^.!?]+)$"
ACTION_HEAD, ACTIONS_KEPT = r"(?i)^\s*(?:action|todo|follow up):\s*", 8
SENTENCE_WORDS, SENTENCE_LEAST, CARD_LEAST, CARD_SURE = 4, 0.15, 0.3, 0.6


def action_item(line: Column) -> Column:
    """(text, owner, deadline) of the action that a line names by the first pattern that it fits, else null; parts it lacks are null."""
    line = F.trim(line)
    blank = lambda c: F.nullif(c, F.lit(""))
    part = lambda n: [F.regexp_extract(line, borders(p), n) for p in ACTION_LINES]
    said, until = F.lit(""), F.lit("")
    for p, a, b in reversed(list(zip(ACTION_LINES, part(1), part(2)))):
        said, until = F.when(matches(line, p), a).otherwise(said), F.when(matches(line, p), b).otherwise(until)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(said, ACTION_HEAD, ""), r"\s+", " "), r"[.!?]+$", ""))
    name = F.regexp_extract(line, borders(ACTION_OWNER), 1)
    owner = F.when(F.lower(name) == "i", "Me").otherwise(F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 1000)))
    deadline = F.coalesce(blank(until), blank(F.regexp_extract(line, borders(ACTION_DEADLINE), 1)))
    return F.when(text != "", F.struct(text.alias("text"), F.when(name != "", owner).alias("owner"), F.trim(deadline).alias("deadline")))


def weakest_sentence(body: Column, source: Column, words) -> Column:
    """The least share of words that the source holds, over the body's sentences of some words; null if there are none."""
    sentences = F.split(F.regexp_replace(body, r"([.!?])\s+", "$1\u0001"), "\u0001")
    lower = F.lower(source)

    def share(own: Column) -> Column:
        once = F.array_distinct(own)
        return F.when(F.size(own) >= SENTENCE_WORDS, F.size(F.filter(once, lambda w: F.contains(lower, w))) / F.size(once).cast("double"))

    return F.array_min(F.transform(sentences, lambda x: share(words(x))))
