"""Meeting summaries from chunk findings: similar texts merged in order, sections with a cap, a timeline."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.transcripts import fold_sorted

SECTION_CAP, TIMELINE_CAP, EVIDENCE = 500, 20, 3
_DROPPED = re.compile(r"(?<![A-Za-z0-9_])(?:the|a|an|to|for|and|or|of|in|on|by|with|from)(?![A-Za-z0-9_])")


def merge_words(text: str) -> frozenset[str]:
    return frozenset(_DROPPED.sub(" ", re.sub(r"[^a-z0-9\s]", " ", text.lower())).split())


class Leaders:
    """Texts merged in order: one joins the first kept text that it is like, and the longer of the two stays.

    Alike are word sets with a Dice coefficient of at least ``like`` whose sizes differ by the factor ``ratio`` at most.
    Such sets share so many words that their leading parts, in one order of all words, have one in common; a kept text is
    filed under the words of its part (long words first: they are rare) in its zone of sizes, so a new one is compared
    with few. What is held grows with the different texts of a group, not with its rows.
    """

    def __init__(self, like: float = 0.8, ratio: float = 0.6) -> None:
        self.like, self.ratio = like, ratio
        self.texts: list[str] = []
        self.evidence: list[list[int]] = []
        self._words: list[frozenset[str]] = []
        self._filed: dict[tuple[str, int], list[int]] = {}
        self.compared = 0

    def _zone(self, size: int) -> int:
        return size.bit_length()

    def _part(self, words: frozenset[str]) -> list[str]:
        n = len(words)
        return sorted(words, key=lambda w: (-len(w), w))[: n - math.ceil(n * self.like / (2 - self.like) - 1e-9) + 1]

    def _file(self, at: int) -> None:
        for w in self._part(self._words[at]):
            self._filed.setdefault((w, self._zone(len(self._words[at]))), []).append(at)

    def add(self, text: str, mark: int, words: frozenset[str] | None = None) -> None:
        mine = merge_words(text) if words is None else words
        n = len(mine)
        zones = range(self._zone(max(1, math.floor(n * self.ratio))), self._zone(math.ceil(n / self.ratio)) + 1)
        for at in sorted({k for w in self._part(mine) for z in zones for k in self._filed.get((w, z), ())}) if n else ():
            other = self._words[at]
            self.compared += 1
            if min(n, len(other)) / max(n, len(other)) >= self.ratio and 2 * len(mine & other) / (n + len(other)) >= self.like:
                if len(text.strip()) > len(self.texts[at].strip()):
                    self.texts[at], self._words[at] = text, mine
                    self._file(at)
                if len(self.evidence[at]) < EVIDENCE:
                    self.evidence[at].append(mark)
                return
        self.texts.append(text)
        self.evidence.append([mark])
        self._words.append(mine)
        if n:
            self._file(len(self.texts) - 1)


def merge_similar(rows: DataFrame) -> DataFrame:
    """(conv_id, item, text, evidence): the texts of (conv_id, seq, text) merged in order, and how many rows vouch for each.

    Rows stream by in order, sorted by Spark; a task holds a conversation's different texts.
    """

    def fold(own: Iterable) -> Iterator[tuple]:
        kept = Leaders()
        for row in own:
            kept.add(row.text, row.seq)
        for n, (text, marks) in enumerate(zip(kept.texts, kept.evidence)):
            yield n, text, len(marks)

    return fold_sorted(rows.select("conv_id", "seq", "text"), fold, "conv_id long, item int, text string, evidence int")


def sections(findings: DataFrame, titles: list[str], cap: int = SECTION_CAP) -> DataFrame:
    """(conv_id, section, place, text, evidence, dropped): findings (conv_id, seq, section, text) under declared titles.

    Titles are met without regard to case and outer blanks; findings under others are left out. Each section merges
    similar findings in order, and keeps the first ``cap``; ``dropped`` tells how many more there were.
    """
    known = {t.strip().lower(): n for n, t in enumerate(titles)}
    number = F.create_map(*[x for t, n in known.items() for x in (F.lit(t), F.lit(n))])[F.lower(F.trim("section"))]
    declared = findings.withColumn("number", number).where("number IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")

    def fold(own: Iterable) -> Iterator[tuple]:
        kept: dict[int, Leaders] = {}
        for row in own:
            kept.setdefault(row.number, Leaders()).add(row.text, row.seq)
        for n in sorted(kept):
            found = kept[n]
            for place, (text, marks) in enumerate(zip(found.texts[:cap], found.evidence)):
                yield titles[n], place, text, len(marks), max(0, len(found.texts) - cap)

    return fold_sorted(declared.select("conv_id", "seq", "number", "text"), fold, "conv_id long, section string, place int, text string, evidence int, dropped int")


def timeline(items: DataFrame, cap: int = TIMELINE_CAP) -> DataFrame:
    """(conv_id, place, kind, title, at_ms): the ``cap`` first items (conv_id, seq, order, kind, title, at_ms) of each conversation.

    Items without a time come first; items of one time go by ``order``, then ``seq``. Tasks cut a conversation to its
    first items before rows move.
    """
    order = Window.partitionBy("conv_id").orderBy(F.coalesce("at_ms", F.lit(0).cast("long")), "order", "seq")
    placed = items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    return placed.select("conv_id", (F.col("place") - 1).alias("place"), "kind", "title", "at_ms")
