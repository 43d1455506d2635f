"""HTML extraction with templates deduced from equivalence classes.

A page is read as a sequence of tokens: the start and the end of each element (its path of tag and class names) and each
text block (path and text). Tokens of a host whose occurrence vectors are equal, page for page, form an equivalence
class. Vectors are never gathered: a class is known by an order-free hash of (page, count) pairs that tasks aggregate
before the shuffle, so a host with a third of all pages is no bottleneck. A class counts if enough pages have it and it
holds several elements. It must be ordered: in every page its tokens come in one order, over and over; tokens that leave
the order on some page are taken out of the class. And classes must nest: no two overlap in part, the lesser of two that
do goes; and a class stands in one and the same gap of the class around it. Tokens outside the valid classes are then
told apart by the gap they stand in, and classes are sought again among them, until a round finds none. Tokens of a gap
with the vector of the class around it, once in each of its occurrences, belong to that class, however few they are.
Text tokens of valid classes belong to the template; blocks inside an article are no text tokens, so an article that
all pages of a host repeat stays. What is left of a page are its slots: of these, the parts that the page itself marks as menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments are dropped, and the article (or, where a page marks none, all the rest) is kept.
A name marks a part only by a whole word beside neutral ones (ad-box, not related-work); inside an article prose
elements are never marked, and words that prose may need (discussion, search) don't count. A page whose text is template
throughout, as copies of one page are, keeps it all.

Null html gives the empty text; null or odd urls share one nameless host. Repeated rows are extracted one by one (each
counts as a page). Pages may be truncated or badly nested; whole pages are read, however long, nothing is capped. An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialize, table

LEAST_PAGES, LEAST_ELEMENTS, BROADCAST_ROWS = 8, 3, 100_000
START, TEXT, END = 0, 1, 2  # kinds of tokens, in the lowest two bits of their numbers

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_BLANK = re.compile(r"\s+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NO_TEXT = set("script style noscript template iframe head title nav footer aside form button select option textarea input label fieldset legend object canvas svg audio video map dialog menu xmp noembed noframes".split())
#: Words in class, id and role that mark a part as no article text.
_MARKS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs footer contentinfo sidebar aside complementary widget widgets related recommended ad ads adv advert adverts advertisement advertising adsense adbox banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login search share sharing social comment comments commentlist disqus reply replies respond discussion form pagination pager toolbar copyright".split())
#: Inside an article only words that prose has no use for, on parts that aren't prose themselves.
_INNER_MARKS = _MARKS - set("notice notices notification alert banner comment search form discussion reply replies respond related recommended widget widgets dialog copyright complementary toolbar promotion".split()) | {"related", "recommended"}
#: Words beside a mark in a name, such as ad-box; with any other word beside it (related-work) a name marks nothing.
_NEUTRAL = set("box block container wrapper wrap list section area slot unit bar item items inner content banner link links button buttons icon icons form policy header footer top bottom left right main site page post article thread notice widget js".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption article main".split())
_HEAD_MARKS = {"masthead", "topbar", "banner", "header"}
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre", "blockquote", "form", "hr", "header", "footer", "nav", "aside", "main", "address", "dl", "figure", "fieldset"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _names(tag: str, attributes: str) -> tuple[set[str], set[str]]:
    """The words in an element's class, id and role, and those that stand alone or beside neutral words in a name."""
    out: set[str] = set()
    clear: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in _NAME.findall(name)}
            out |= words
            marks = words & (_MARKS | _HEAD_MARKS)
            if marks and not words - marks - _NEUTRAL:
                clear |= words
    return out, clear


class Page:
    """Blocks of one page, as (path, text, dropped, in the article), and its sequence of (kind, path or block number)."""

    def __init__(self, source: str) -> None:
        self.sequence: list[tuple[int, str | int]] = []
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self._stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, dropped, in the article
        self._text: list[str] = []
        self._linked = self._all = 0
        self._read(source)
        self._end_block()
        self._close(1)

    def _close(self, k: int) -> None:
        """End the open elements from the k-th on."""
        self.sequence.extend((END, path) for _, path, _, _ in reversed(self._stack[k:]))
        del self._stack[k:]

    def _end_block(self) -> None:
        if self._text:
            text = _BLANK.sub(" ", entities.unescape("".join(self._text))).strip()
            _, path, dropped, main = self._at
            if text:
                self.sequence.append((TEXT, len(self.blocks)))
                self.blocks.append((path, text, dropped, main))
            self._text = []

    def _add(self, text: str) -> None:
        top = next((x for x in reversed(self._stack) if x[0] not in _INLINE), self._stack[0])
        if not self._text:
            self._at = (top[0], top[1], self._stack[-1][2], top[3])
        elif self._stack[-1][2] != self._at[2]:
            self._end_block()
            self._at = (top[0], top[1], self._stack[-1][2], top[3])
        self._text.append(text)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _CLOSED_BY or len(self._stack) > 1:
            for k in range(len(self._stack) - 1, 0, -1):
                name = self._stack[k][0]
                if tag in _CLOSED_BY.get(name, ()):
                    self._close(k)
                    break
                if name not in _INLINE:
                    break
        names, clear = _names(tag, attributes)
        _, path, dropped, main = self._stack[-1]
        inside = main or tag in ("article", "main") or _MAIN_ROLE.search(attributes) is not None
        if tag not in ("html", "body", "main"):
            if tag == "article":
                marked = clear & {"comment", "comments", "reply", "ad", "advert", "advertisement", "sponsored", "promo", "related"}
            elif main:
                marked = clear & _INNER_MARKS if tag not in _PROSE else set()
            else:
                marked = clear & _MARKS
            head = not main and (tag == "header" or clear & _HEAD_MARKS and tag not in _PROSE)
            dropped = dropped or tag in _NO_TEXT or bool(marked) or bool(head)
        path = f"{path}/{tag}" + ("." + ".".join(sorted(names)) if names else "")
        self.sequence.append((START, path))
        if tag not in _VOID:
            self._stack.append((tag, path, dropped, inside))

    def _read(self, source: str) -> None:
        at, find = 0, _TOKEN.search
        while True:
            m = find(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                self._add(text)
            if not m:
                return
            at = m.end()
            if m[1] is not None:
                self._add(m[1])
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag == "br":
                self._add(" ")
                continue
            if tag not in _INLINE:
                self._end_block()
            if m[2]:
                for k in range(len(self._stack) - 1, 0, -1):
                    if self._stack[k][0] == tag:
                        self._close(k)
                        break
            else:
                self._open(tag, m[4] or "")
                if tag in _RAW and tag not in _VOID:
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(len(self._stack) - 1)

    def text(self, template: set[int]) -> str:
        """The article, joined by newlines; ``template`` holds the numbers of blocks to leave out."""
        shown = [b for b in self.blocks if not b[2]]
        kept = [b for k, b in enumerate(self.blocks) if not b[2] and k not in template] or shown  # no class takes all of a page
        if any(b[3] for b in kept):
            kept = [b for b in kept if b[3]]
        return "\n".join(b[1] for b in kept)


def token(kind: int, *parts: str) -> int:
    import xxhash

    return (xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)) & ~3 | kind


def _mix(a: int, b: int) -> int:
    """A number from two, of the kind of the first."""
    import xxhash

    return (xxhash.xxh64_intdigest(struct.pack("<qq", a, b)) - (1 << 63)) & ~3 | a & 3


def page_tokens(page: Page) -> tuple[list[int], list[int]]:
    """The numbers of a page's tokens in order, and the block of each (-1: an element)."""
    numbers, blocks = [], []
    for kind, what in page.sequence:
        if kind != TEXT:
            numbers.append(token(kind, what))
            blocks.append(-1)
        elif not page.blocks[what][2] and not page.blocks[what][3]:
            numbers.append(token(TEXT, *page.blocks[what][:2]))
            blocks.append(what)
    return numbers, blocks


class Member:
    """A role's place in its class."""

    __slots__ = ("cls", "at", "last", "vector", "rank")

    def __init__(self, cls: int, at: int, last: int, vector: int, rank: tuple[int, ...]) -> None:
        self.cls, self.at, self.last, self.vector, self.rank = cls, at, last, vector, rank


def _members(classes: list[dict] | None) -> dict[int, Member]:
    """The members of classes by role."""
    out = {}
    for c in classes or ():
        rank = (c["pages"], len(c["roles"]), c["cls"])
        out.update((role, Member(c["cls"], at, len(c["roles"]) - 1, c["vector"], rank)) for at, role in enumerate(c["roles"]))
    return out


def _rounds(classes: list[dict] | None) -> list[dict[int, Member]]:
    """The members of the valid classes, by the round that found them."""
    by_round: dict[int, list[dict]] = {}
    for c in classes or ():
        by_round.setdefault(c["round"], []).append(c)
    return [_members(by_round[r]) for r in sorted(by_round)]


def roles_of(numbers: list[int], rounds: list[dict[int, Member]]) -> tuple[list[int], list[tuple[int, int]], list[Member | None]]:
    """Per token of a page: its role (number and gap), the gap it stands in with the vector of the class around it, and
    its place in a valid class."""
    roles, around, held = list(numbers), [(0, 0)] * len(numbers), [None] * len(numbers)
    for members in rounds:
        held = [h or members.get(role) for h, role in zip(held, roles)]
        open_: list[list[int]] = [[0, 0, 0]]  # class, gap, vector
        for i, h in enumerate(held):
            if h is None:
                _, gap, vector = open_[-1]
                roles[i], around[i] = _mix(numbers[i], gap) if gap else numbers[i], (gap, vector)
                continue
            if h.at == 0:
                open_.append([h.cls, 0, h.vector])
            open_[-1][1] = _mix(roles[i], h.cls)
            if h.at == h.last:
                open_.pop()
                if open_[-1][2] == h.vector:  # part of the class around it: the gap ends here
                    open_[-1][1] = _mix(open_[-1][1], h.cls)
    return roles, around, held


def out_of_order(keys: list[int], size: int) -> set[int]:
    """Of the places in a class whose order a page should repeat, those that leave it: all that aren't in each of the
    longest rising sequences of ``keys`` (turn * size + place)."""
    if all(a < b for a, b in zip(keys, keys[1:])):
        return set()

    def lengths(values: Iterable[int]) -> list[int]:
        ends: list[int] = []
        out = []
        for v in values:
            at = bisect_left(ends, v)
            ends[at : at + 1] = [v]
            out.append(at + 1)
        return out

    ending = lengths(keys)
    starting = lengths(-k for k in reversed(keys))[::-1]
    longest = max(ending)
    on = [e + s - 1 == longest for e, s in zip(ending, starting)]
    level = Counter(e for e, o in zip(ending, on) if o)
    return {k % size for k, e, o in zip(keys, ending, on) if not o or level[e] > 1}


def nesting(roles: list[int], held: list[Member | None], new: dict[int, Member]) -> tuple[dict[int, set[int]], set[int], set[int]]:
    """For one page: the gaps each new class stands in, the new classes that must give way as they overlap with a better
    class, and those that occur twice within one occurrence of the class around them."""
    gaps: dict[int, set[int]] = {}
    lost: set[int] = set()
    twice: set[int] = set()
    seen: dict[int, int] = {}
    open_: list[tuple[Member | None, list[int]]] = [(None, [0, 0])]  # gap and number of the occurrence
    for i, (role, known) in enumerate(zip(roles, held)):
        h = known or new.get(role)
        if h is None:
            continue
        if h.at == 0:
            if not known:
                gap, occurrence = open_[-1][1]
                gaps.setdefault(h.cls, set()).add(gap)
                if seen.get(h.cls) == occurrence:
                    twice.add(h.cls)
                seen[h.cls] = occurrence
            open_.append((h, [0, i + 1]))
        at = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][0].cls == h.cls), 0)
        if not at:
            lost.add(h.cls)  # cut off by a class that overlaps
            continue
        better = lambda m: (m.cls not in gaps, m.rank)  # noqa: E731  valid classes first
        over = [other for other, _ in open_[at + 1 :]]
        cut = {m.cls for m in over if better(m) < better(h)} | ({h.cls} if any(better(m) > better(h) for m in over) else set())
        if cut:  # those that give way are no longer open
            lost |= cut
            open_ = [o for o in open_ if o[0] is None or o[0].cls not in cut]
        if h.cls not in cut:
            open_[at][1][0] = _mix(role, h.cls)
            if h.at == h.last:
                del open_[at]
    return gaps, lost, twice


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host")


def _sequences(pages: DataFrame) -> DataFrame:
    """(host, page, tokens): a hash that stands for the page, and the numbers of its tokens in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            marks, numbers = [], []
            for page_id, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                marks.append(xxhash.xxh64_intdigest(f"{page_id}\x00".encode() + (source or "").encode("utf-8", "surrogatepass")) - (1 << 63))
                numbers.append(page_tokens(Page(source or ""))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array(numbers, pa.list_(pa.int64()))], ["host", "page", "tokens"])

    return pages.select(_host(), F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "host string, page long, tokens array<long>")


def _by_host(rows: DataFrame, **tables: DataFrame) -> DataFrame:
    """``rows`` with the classes of their host, as a column per table: a page's worth of tokens per host."""
    for name, classes in tables.items():
        hosts = classes.groupBy("host").agg(F.collect_list(F.struct("round", "cls", "vector", "pages", "roles")).alias(name))
        few = classes.agg(F.sum(F.size("roles") + 10)).first()[0] or 0
        rows = rows.join(F.broadcast(hosts) if few <= BROADCAST_ROWS else hosts, "host", "left")
    return rows


class _Cache:
    """What is made of the classes of a host, for the last hosts that a task met."""

    def __init__(self, make) -> None:
        self._make, self._made = make, {}

    def get(self, host: str, column: pa.Array, k: int):
        if host not in self._made:
            if len(self._made) >= 64:
                self._made.clear()
            self._made[host] = self._make(column[k].as_py())
        return self._made[host]


def _found(sequences: DataFrame, known: DataFrame) -> DataFrame:
    """(host, kind of row, role, gap, around, mark, first) per page and different role outside the valid classes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache = _Cache(_rounds)
        for batch in batches:
            rows: list[tuple] = []
            for k, (host, page, numbers) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)])):
                roles, around, held = roles_of(numbers, cache.get(host, batch.column(3), k))
                counts = Counter(r for r, h in zip(roles, held) if h is None)
                seen = set()
                for i, (role, (gap, vector)) in enumerate(zip(roles, around)):
                    if held[i] is None and role not in seen:
                        seen.add(role)
                        mark = xxhash.xxh64_intdigest(struct.pack("<qq", page, counts[role])) - (1 << 63)
                        rows.append((host, role, gap, vector, mark, (page >> 25 & (1 << 38) - 1) << 24 | min(i, (1 << 24) - 1)))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 5])], ["host", "role", "gap", "around", "mark", "first"])

    return _by_host(sequences, known=known).select("host", "page", "tokens", "known").mapInArrow(run, "host string, role long, gap long, around long, mark long, first long")


def _candidates(sequences: DataFrame, known: DataFrame, least_pages: int, number: int) -> DataFrame:
    """(host, round, cls, vector, around, pages, roles): the classes of a round, in the order of one of their pages."""
    # A sum, in halves that can't overflow: repeated rows don't cancel as in an XOR.
    halves = F.xxhash64(F.sum(F.shiftright("mark", 32)), F.sum(F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF))))
    found = _found(sequences, known).groupBy("host", "role").agg(halves.alias("vector"), F.count("*").alias("pages"), F.min("first").alias("first"), F.min("gap").alias("gap"), F.min("around").alias("around"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"])
    classes = found.where(F.col("pages") >= least_pages).groupBy("host", "gap", "around", "vector", "pages").agg(ordered.alias("roles"))
    return classes.select("host", F.lit(number).alias("round"), F.xxhash64(F.lit(number), "gap", "vector").alias("cls"), "vector", "around", "pages", "roles")


def _large(least_elements: int) -> F.Column:
    return F.size(F.filter("roles", lambda r: r.bitwiseAND(F.lit(3)) == START)) >= least_elements


def _valid_form(least_elements: int) -> F.Column:
    return (F.size("roles") > 0) & (_large(least_elements) | (F.col("vector") == F.col("around")))


def _movers(sequences: DataFrame, known: DataFrame, candidates: DataFrame) -> DataFrame:
    """(host, cls, role): roles that leave the order of their class on some page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = _Cache(_rounds), _Cache(_members)
        for batch in batches:
            rows: set[tuple] = set()
            for k, (host, numbers) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(2)])):
                fresh = new.get(host, batch.column(3), k)
                roles, _, held = roles_of(numbers, old.get(host, batch.column(2), k))
                turns: Counter = Counter()
                keys: dict[int, list[tuple[int, int]]] = {}
                for role, h in zip(roles, held):
                    if h is None and role in fresh:
                        m = fresh[role]
                        keys.setdefault(m.cls, []).append((turns[role] * (m.last + 1) + m.at, role))
                        turns[role] += 1
                for cls, some in keys.items():
                    size = fresh[some[0][1]].last + 1
                    out = out_of_order([key for key, _ in some], size)
                    rows.update((host, cls, role) for key, role in some if key % size in out)
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()])], ["host", "cls", "role"])

    rows = _by_host(sequences, known=known, fresh=candidates).where("fresh IS NOT NULL").select("host", "tokens", "known", "fresh")
    return rows.mapInArrow(run, "host string, cls long, role long").distinct()


def _nested(sequences: DataFrame, known: DataFrame, ordered: DataFrame) -> DataFrame:
    """(host, cls, good, once): good classes stand in one gap on all pages and give way to none; once: at most once there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = _Cache(_rounds), _Cache(_members)
        for batch in batches:
            rows: set[tuple] = set()
            for k, (host, numbers) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(2)])):
                roles, _, held = roles_of(numbers, old.get(host, batch.column(2), k))
                gaps, lost, twice = nesting(roles, held, new.get(host, batch.column(3), k))
                rows.update((host, cls, gap, cls not in lost, cls not in twice) for cls, some in gaps.items() for gap in some)
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()])], ["host", "cls", "gap", "good", "once"])

    rows = _by_host(sequences, known=known, fresh=ordered).where("fresh IS NOT NULL").select("host", "tokens", "known", "fresh")
    found = rows.mapInArrow(run, "host string, cls long, gap long, good boolean, once boolean")
    return found.groupBy("host", "cls").agg((F.bool_and("good") & (F.min("gap") == F.max("gap"))).alias("good"), F.bool_and("once").alias("once"))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_elements: int = LEAST_ELEMENTS) -> DataFrame:
    """(host, round, cls, vector, around, pages, roles): the valid classes of each host, their roles in order."""
    spark = pages.sparkSession
    sequences = materialize(_sequences(pages), "sequences")
    number, known = 0, spark.createDataFrame([], "host string, round int, cls long, vector long, around long, pages long, roles array<long>")
    while True:
        found = materialize(_candidates(sequences, known, least_pages, number).where(_valid_form(least_elements)), "candidates")
        movers = _movers(sequences, known, found).groupBy("host", "cls").agg(F.collect_set("role").alias("movers"))
        kept = found.join(movers, ["host", "cls"], "left").withColumn("roles", F.when(F.col("movers").isNull(), F.col("roles")).otherwise(F.array_except("roles", "movers")))
        ordered = materialize(kept.select(*known.columns).where(_valid_form(least_elements)), "ordered")
        good = ordered.join(_nested(sequences, known, ordered), ["host", "cls"]).where(F.col("good") & (_large(least_elements) | F.col("once")))
        after = materialize(known.union(good.select(*known.columns)), "templates")
        before, now = known.count(), after.count()
        discard(found, ordered)
        known, number = after, number + 1
        if before == now:
            discard(sequences)
            return known


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_elements: int = LEAST_ELEMENTS) -> DataFrame:
    """page_id, url, text of every row."""
    valid = templates(pages, least_pages, least_elements)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(_rounds)
        for batch in batches:
            texts = []
            for k, (source, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                page, rounds = Page(source or ""), cache.get(host, batch.column(4), k)
                drop: set[int] = set()
                if rounds and any(not b[2] and not b[3] for b in page.blocks):
                    numbers, blocks = page_tokens(page)
                    drop = {b for b, h in zip(blocks, roles_of(numbers, rounds)[2]) if h and b >= 0}
                texts.append(page.text(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return _by_host(rows, known=valid).select("page_id", "url", "html", "host", "known").mapInArrow(run, "page_id long, url string, text string")


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


#: The driver's pages mark their text by one article element; h1 and p begin its blocks. SQL reads them so.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, i, list[i] AS raw FROM (SELECT page_id, url, string_split_regex(h, '</?(h1|p)>') AS list FROM a), unnest(range(1, len(list) + 1)) AS r(i)),
c AS (SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(raw, '&(amp|lt|gt|quot)$', '&\1;'), '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text, CAST(length(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '')) AS BIGINT) AS n_chars FROM c GROUP BY page_id, url
"""
