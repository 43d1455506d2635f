"""Words that a coder knows are looked up by Arrow, not learnt again; what it gives stays the tokenizer's own."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import numpy as np

from loomline.llm import tokens


def _texts() -> list[str]:
    random.seed(3)
    odd = ["", " ", "\n", "a  b", "x\ty", "é" * 70, "a" * 200 + " b", "<|endoftext|> a", "İ i", "abc, def!"]
    return odd + [" ".join("".join(random.choice("abcé,!Z<|>") for _ in range(random.randint(1, 9))) for _ in range(30)) for _ in range(20)]


def _checked(coder: tokens.Coder, texts: list[str]) -> None:
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(c, coder.dtype).tolist() for c in coder.encode(texts)] == want


def test_known_words_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "_LIMIT", 10)
    coder, asked = tokens.Coder(tokens.default_path(tokens.WORD_END)), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda need: (asked.extend(need), learn(need)))
    words = [w for t in _texts() for w in t.split() if len(w) <= 64]
    for _ in range(2):
        _checked(coder, [" ".join(words)])
    assert len(asked) == len(set(asked))


def test_trimmed_words(monkeypatch):
    monkeypatch.setattr(tokens, "_KNOWN", 50, raising=False)
    coder, texts = tokens.Coder(tokens.default_path(tokens.WORD_END)), _texts()
    for k in range(0, len(texts), 3):
        _checked(coder, texts[k : k + 3])
    assert coder.encode([]) == [] and len(coder.known.words) <= 50
    _checked(coder, texts)


def test_words_of_every_call_outlast_a_trim(monkeypatch):
    monkeypatch.setattr(tokens, "_KNOWN", 60)
    coder, asked = tokens.Coder(tokens.default_path(tokens.WORD_END)), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda need: (asked.extend(need), learn(need)))
    for k in range(6):
        _checked(coder, ["the of and to " + " ".join(f"{'abcdef'[k]}x{'abcdefghij'[n % 10]}{'klmn'[n // 10]}" for n in range(40))])
    assert [asked.count(w) for w in ("the", "of", "and", "to")] == [1] * 4


_MEMORY = """
import random, re, sys
from loomline.llm import tokens

def anon():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

random.seed(1)
coder = tokens.coder(tokens.default_path(tokens.BYTE_LEVEL))
coder.encode(["some words"])
before = anon()
for _ in range(30):
    coder.encode([" ".join("".join(random.choices("abcdefghij", k=8)) for _ in range(1000)) for _ in range(20)])
print(anon() - before)
"""


def test_a_worker_holds_few_bytes_a_word():
    """600,000 different words; in dictionaries they took 91 MB, in each worker."""
    run = subprocess.run([sys.executable, "-c", _MEMORY], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(run.stdout) < 70, run.stdout
