"""Keyed state machines as folds: a start state and a step (state, row) -> (state, outputs).

States are flat dictionaries of numbers and strings, so that one fold serves batch frames and streaming state alike.
Rows reach a fold in the order of their key's event time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Fold:
    start: dict
    step: Callable[[dict, dict], tuple[dict, list[dict]]]


def voice_activity(start: float = 185, end: float = 100, hangover_ms: int = 500) -> Fold:
    """Idle, speech, hangover with two thresholds on ``level``."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        level, now, state, since = row["level"], row["at_ms"], s["state"], s["since"]
        if state == "idle" and level > start:
            state = "speech"
        elif state == "speech" and level < end:
            state, since = "hangover", now
        elif state == "hangover":
            if level > start:
                state = "speech"
            elif now - since > hangover_ms:
                state = "idle"
        return {"state": state, "since": since}, [{"state": state}]

    return Fold({"state": "idle", "since": 0}, step)


def suppress_silence(multiplier: float = 3.0, floor: float = 20.0, alpha: float = 0.02, hangover_ms: int = 200, keepalive_ms: int = 100) -> Fold:
    """Send, send silence or suppress a frame; the threshold follows a moving average of the level in silence."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        s, level, now = dict(s), row["level"], row["at_ms"]
        edge = ""
        if level >= max(s["noise"] * multiplier, floor):
            edge = "" if s["speaking"] else "started"
            s.update(state="active", last=now, speaking=1)
            return s, [{"action": "send", "edge": edge}]
        if s["state"] != "suppressed":
            if now - s["last"] > hangover_ms:
                s["state"] = "suppressed"
                if s["speaking"]:
                    edge, s["speaking"] = "ended", 0
            else:
                s["state"] = "hangover"
                return s, [{"action": "send", "edge": ""}]
        s["noise"] = s["noise"] * (1 - alpha) + level * alpha
        if now - s["kept"] >= keepalive_ms:
            s["kept"] = now
            return s, [{"action": "silence", "edge": edge}]
        return s, [{"action": "suppress", "edge": edge}]

    return Fold({"state": "suppressed", "last": 0, "kept": 0, "noise": 0.0, "speaking": 0}, step)


def joint_state() -> Fold:
    """Who speaks on two channels (``channel`` a or b, ``speaking``); repeated edges are absorbed."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        c, other = ("a", "b") if row["channel"] == "a" else ("b", "a")
        if s[c] == int(row["speaking"]):
            return s, []
        s = {**s, c: int(row["speaking"]), f"{c}_at": row["at_ms"]}
        joint = {(0, 0): "neither", (1, 0): "a", (0, 1): "b", (1, 1): "both"}[s["a"], s["b"]]
        return s, [{"joint": joint, "since_other": row["at_ms"] - s[f"{other}_at"] if s[f"{other}_at"] >= 0 else -1}]

    return Fold({"a": 0, "b": 0, "a_at": -1, "b_at": -1}, step)


def drop_near_repeats(within_ms: int = 500) -> Fold:
    """Rows less those equal in ``what`` to the row kept last, less than ``within_ms`` after it."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        if s["what"] == row["what"] and abs(row["at_ms"] - s["at"]) < within_ms:
            return s, []
        return {"what": row["what"], "at": row["at_ms"]}, [{"kept": row["what"]}]

    return Fold({"what": "", "at": -(10**15)}, step)


def _bare(text: str) -> list[str]:
    return [re.sub(r"[^\w]+", "", w.lower()) for w in text.split()]


def merge_chunks(base: str, more: str) -> str:
    """Join two overlapping transcripts: prefix replaced, suffix ignored, longest word overlap, else appended."""
    if not more.split():
        return base
    if not base.split():
        return more
    a, b, words_a, words_b = _bare(base), _bare(more), base.split(), more.split()
    if b[: len(a)] == a:
        return more
    if a[-len(b) :] == b:
        return base
    for n in range(min(len(a), len(b)), 0, -1):
        if a[-n:] == b[:n]:
            return " ".join(words_a + words_b[n:])
    return " ".join(words_a + words_b)


def merged_transcript() -> Fold:
    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        text = merge_chunks(s["text"], row["text"])
        return {"text": text}, [{"words": len(text.split())}]

    return Fold({"text": ""}, step)


def rolling_text(most: int = 8192, separator: str = "\n") -> Fold:
    """Committed segments and a tail in progress; over ``most`` characters the oldest segments leave."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        done, tail, text = s["done"], s["tail"], row["text"].strip()
        if text:
            if row["final"]:
                done, tail = (done + separator if done else "") + text, ""
            else:
                tail = text
            while len(done) + len(tail) > most and separator in done:
                done = done.split(separator, 1)[1]
        return {"done": done, "tail": tail}, [{"chars": len(done) + len(tail), "segments": done.count(separator) + 1 if done else 0}]

    return Fold({"done": "", "tail": ""}, step)


def ask_ledger(most_open: int = 12, answer_words: int = 8, shared: int = 2) -> Fold:
    """Open questions of a conversation: asks open or re-open them, long replies that share words answer them."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        asks = [a for a in s["asks"].split("\x1e") if a]
        words = {w for w in _bare(row["text"]) if len(w) > 3}
        answered = 0
        if row["ask"]:
            mark = " ".join(sorted(words))
            asks = [a for a in asks if a != mark] + ([mark] if mark else [])
            asks = asks[-most_open:]
        elif len(row["text"].split()) >= answer_words:
            left = [a for a in asks if len(words & set(a.split())) < shared]
            answered, asks = len(asks) - len(left), left
        return {"asks": "\x1e".join(asks)}, [{"open": len(asks), "answered": answered}]

    return Fold({"asks": ""}, step)


def compact_log(most: int = 1800, fold: int = 500, keep_markers: int = 5) -> Fold:
    """Segments held and summary markers made when a log outgrows ``most``: its oldest ``fold`` become one marker."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        held, markers = s["held"] + 1, s["markers"]
        if held > most:
            held, markers = held - fold, min(keep_markers, markers + 1)
        return {"held": held, "markers": markers}, [{"held": held, "markers": markers}]

    return Fold({"held": 0, "markers": 0}, step)


INTERIM_CHARS, INTERIM_AGE_MS, ANCHOR_WORDS = 1200, 30_000, 8  # fixed values


def interim_novelty(interim: str, finals: list[str], age_ms: int) -> tuple[str, str]:
    """(inject or why not, text): what follows the last words of the newest final found in an interim text.

    Without such an anchor the text itself, or its last 1,200 characters from a word on. Anchors are the last eight
    words, at least three with ten letters in all, of ten finals.
    """
    text = interim.strip()
    if not text:
        return "empty", ""
    if age_ms > INTERIM_AGE_MS:
        return "stale", ""
    if finals and finals[-1] == interim:
        return "duplicate", ""
    words = lambda t: [(m[0].lower().replace("'", ""), m.end()) for m in re.finditer(r"[^\W_]+(?:'[^\W_]*)*|'+", t)]
    mine = words(text)
    if not mine:
        return "empty", ""
    for final in reversed(finals[-10:]):
        anchor = [w for w, _ in words(final)][-ANCHOR_WORDS:]
        if len(anchor) < 3 or len("".join(anchor)) < 10:
            continue
        for at in range(len(mine) - len(anchor), -1, -1):
            if [w for w, _ in mine[at : at + len(anchor)]] == anchor:
                tail = re.sub(r"^[\s.,;:!?…]+", "", text[mine[at + len(anchor) - 1][1] :]).strip()
                return ("inject", _last_chars(tail)) if tail else ("no_novel_content", "")
    return "inject", _last_chars(text)


def _last_chars(text: str) -> str:
    if len(text) <= INTERIM_CHARS:
        return text
    start = len(text) - INTERIM_CHARS
    space = text.find(" ", start)
    return text[start if space < 0 else space + 1 :].strip()


def pending_question(echo_ms: int = 5000, stable_ms: int = 900, most_age_ms: int = 90_000) -> Fold:
    """Finals of the other side that wait for an answer: echoes of one's own words within ``echo_ms`` don't count, what
    waits longer than ``most_age_ms`` is dropped, and a pause of ``stable_ms`` before a row fires the question."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        now, words = row["at_ms"], " ".join(_bare(row["text"]))
        since = s["since"] if s["pending"] and now - s["since"] <= most_age_ms else now
        pending = s["pending"] if since == s["since"] else 0
        fired = int(pending > 0 and now - s["last"] >= stable_ms)
        if fired:
            pending, since = 0, now
        if row["own"]:
            return {**s, "pending": pending, "since": since, "own": words, "own_at": now}, [{"pending": pending, "echo": 0, "fired": fired}]
        echo = int(bool(words) and now - s["own_at"] <= echo_ms and words in s["own"])
        if not echo:
            since, pending = (since if pending else now), pending + 1
        return {**s, "pending": pending, "since": since, "last": s["last"] if echo else now}, [{"pending": pending, "echo": echo, "fired": fired}]

    return Fold({"pending": 0, "since": 0, "last": 0, "own": "", "own_at": -(10**15)}, step)
