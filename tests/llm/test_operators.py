"""Each operator against a brute-force version on small documents, with nulls, ties, repeats, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loomline.llm import exact_dedup, html_main, mixing, packing, repetition, sharding, simhash, surrogates, tokens, warc, wavelet
from loomline.llm.common import BLANKS, materialize, new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _row string, _key string, label string, _size long"


def _texts() -> list:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(12, 90)) for _ in range(40)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    looped = "one two three four five six seven eight nine ten " * 6
    return [None, "", " \t\n", "a", *base, *near, base[0] + "  ", base[0].replace(" ", "\n"), base[1], base[1], looped, "é ü 漢字 🙂 " + base[2], "x" * 5000, say(9000), "line one\nline one\n\nline two " + base[3]]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", [None, "a", "b", "c", "é"][i % 5], len(t or ""), "d", "r", "k", "l", 7) for i, t in enumerate(_texts())]
    return [*out, out[10], (None, "no id here", "en", "a", 10, "d", "r", "k", "l", 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _normal(t):
    return "".join(c for c in t or "" if c not in BLANKS)


@pytest.mark.parametrize("digest_bytes,memtable", [(32, 48 << 20), (8, 300)])
def test_exact_dedup(docs, rows, digest_bytes, memtable):
    groups = defaultdict(list)
    for r in rows:
        groups[_normal(r[1])].append(r)
    got = exact_dedup.exact_dedup(docs, digest_bytes, 12, memtable).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    want = Counter()
    for norm, g in groups.items():
        first = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in g:
            want[r[0], first[0], len(g), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want


def test_exact_dedup_survives_colliding_digests(docs, rows, monkeypatch):
    """One shared digest for all texts: groups are then told apart by the texts themselves."""
    index = exact_dedup.exact_dedup
    runs = exact_dedup.write_runs(docs, 8)
    assert runs.count() == len(rows)
    bad = runs.selectExpr("substring(sha, 1, 8) AS digest").distinct()
    compacted = exact_dedup.compact(runs.selectExpr("*", "substring(sha, 1, 8) AS digest"))
    apart = exact_dedup._by_text(docs, runs.selectExpr("*", "substring(sha, 1, 8) AS digest"), compacted, bad, 8)
    plain = index(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert apart.select(*plain.columns).exceptAll(plain).count() == 0 == plain.exceptAll(apart.select(*plain.columns)).count()


def test_exact_keep_first_leaves_columns(docs, rows):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({_normal(r[1]) for r in rows}) and all(r["_row"] == "r" and r["_key"] == "k" for r in got)


def _brute_repeats(words: list, k: int) -> set:
    seen = defaultdict(list)
    for i in range(len(words) - k + 1):
        seen[tuple(words[i : i + k])].append(i)
    return {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + k)}


def test_repetition(docs, rows):
    texts = {r[0]: r[1] or "" for r in rows}
    for r in repetition.repetition_rules(docs, block_chars=3000).collect():
        t = texts[r["doc_id"]]
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        five, eight = _brute_repeats(words, 5), _brute_repeats(words, 8)
        failed = len(words) < 10 or 100 * len(five) > 20 * len(words)
        assert (r["n_words"], r["n_repeat_words"], r["covered_words"]) == (len(words), len(five), len(eight))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["word_chars"] == len(_normal(t))
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and 100 * len(eight) <= 20 * len(words) and not _brute_repeats(words, 201))
    kept = repetition.keep_unrepetitive(docs, block_chars=3000)
    verdicts = Counter(r["doc_id"] for r in repetition.repetition_rules(docs).where("kept").collect())
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == verdicts


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 200):
        tokens_ = rng.integers(0, 3, n)
        most = repetition.longest_repeats(tokens_)
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and tokens_[i + k] == tokens_[j + k]:
                    k += 1
                best = max(best, k)
            assert most[i] == best
    assert repetition.repeat_spans("a b c d e f g h x a b c d e f g h".split()) == [(0, 8), (9, 8)]


def test_sharding(docs, rows):
    out = sharding.balanced_shards(docs, shards=5).collect()
    assert len(out) == len(rows)
    count = Counter(r["shard"] for r in out)
    assert set(count) <= set(range(5)) and max(count.values()) - min(count.values()) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in out)
    again = sharding.balanced_shards(docs, shards=5).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_sharding_gathers_groups(spark):
    rows = [(i, f"group {i // 4}") for i in range(400)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    shards = defaultdict(set)
    for r in out:
        shards[r["text_crc32"]].add(r["shard"])
    cut = sum(len(v) - 1 for v in shards.values())
    assert cut < 60  # dealt at random, about 170 of 300 would be cut


def test_mixing_targets_and_bounds(docs, rows):
    slim = docs.select("doc_id", "source", mixing.n_words(docs.text).alias("_size"))
    placed, taken = mixing.mix(slim, block_words=16, slots_per_shard=64)
    size, goal, got, most = Counter(), {}, Counter(), Counter()
    for r in placed.collect():
        size[r["_src"]] += r["_size"]
        goal[r["_src"]] = r["_goal"]
        most[r["_rid"]] = 3 * r["_size"]
    source = {r["_rid"]: r["_src"] for r in placed.collect()}
    by_doc = Counter()
    for r in taken.collect():
        got[source[r["_rid"]]] += r["n"]
        by_doc[r["_rid"]] += r["n"]
    assert sum(goal.values()) == pytest.approx(min(sum(size.values()), 3 * sum(size.values())))
    for s in size:
        assert abs(got[s] - goal[s]) <= 64, (s, got[s], goal[s])
    assert all(by_doc[k] <= most[k] for k in by_doc)
    assert mixing.targets([10, 10, 1000]) == [30.0, 30.0, 960.0]


def test_mixed_documents_hold_the_words_drawn(docs, rows):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    first = mixed.collect()
    own = {r[0]: Counter((r[1] or "").encode().split()) for r in rows}
    for r in first:
        assert not Counter(r["text"].encode().split()) - own[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["_row"] == "r"
    assert Counter(map(tuple, first)) == Counter(map(tuple, mixing.mixed_documents(docs).collect()))


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    got = spark.range(97).select(mixing.permuted(F.col("id"), F.lit(97).cast("long"), F.lit(3)).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(97))


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    out = {}
    for name in (tokens.BYTE_LEVEL, tokens.WORD_END):
        t = Tokenizer.from_file(tokens.default_path(name))
        t.encode_special_tokens = True
        out[name] = lambda text, t=t: t.encode(text, add_special_tokens=False).ids
    return out


ODD = ["", " ", "\n", "  a  b ", "a\n\nb", "a \n b", "it's <|endoftext|> here", "tabs\tand spaces", "Ünïcode ÀÉ straße", "漢字かな", "🙂🙂 x", "don't  stop!!", "9,000.5 (ok)\r\n", "a" * 300, "\x00\x01 b", "<|startoftext|>", "İstanbul DŽ ﬁ", "x y", "foo-bar_baz's"]


@pytest.mark.parametrize("name", [tokens.BYTE_LEVEL, tokens.WORD_END])
def test_coder_gives_the_tokenizers_ids(coders, name):
    texts = ODD + [t or "" for t in _texts()]
    coder = tokens.coder(tokens.default_path(name))
    for _ in range(2):
        assert [np.frombuffer(c, coder.dtype).tolist() for c in coder.encode(texts)] == [coders[name](t) for t in texts]


def test_packing(docs, rows, coders):
    got = packing.pack(docs, window=256).collect()
    want = Counter(tuple(coders[tokens.BYTE_LEVEL](r[1] or "") + [0]) for r in rows)
    placed, whole = defaultdict(dict), defaultdict(dict)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        placed[r["sequence_id"]].update({r["offset"] + i: v for i, v in enumerate(ids)})
        whole[r["sequence_id"] * 256 + r["offset"] - r["start"]].update({r["start"] + i: v for i, v in enumerate(ids)})
    total = sum(map(len, want.elements()))
    assert sorted(placed) == list(range(-(-total // 256)))
    assert all(sorted(p) == list(range(len(p))) for p in placed.values()) and sum(map(len, placed.values())) == total
    assert Counter(tuple(w[i] for i in range(len(w))) for w in whole.values()) == want


def test_wavelet_matrix_and_shards(spark, docs, rows, coders):
    ids = np.random.default_rng(2).integers(0, 900, 3000).astype("<u2")
    shard = wavelet.Shard(wavelet.to_bytes(ids, [4, None], np.array([0, 1000]), 16, 1))
    matrix = shard.matrix
    assert shard.doc_ids == [4, None] and shard.starts.tolist() == [0, 1000] and (matrix.sequence() == ids).all()
    assert (matrix.access(np.arange(3000)) == ids).all()
    for v in (0, 5, 899, 60000):
        assert matrix.rank(v) == (ids == v).sum() and matrix.rank(v, 700) == (ids[:700] == v).sum() and matrix.select(v).tolist() == np.flatnonzero(ids == v).tolist()
    folder = new_path(spark, "shards")
    manifest = materialize(wavelet.write_shards(docs, folder, shard_tokens=700), "manifest")
    assert manifest.count() > 3
    got = sorted(wavelet.read_shards(manifest, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    ends = sorted(p for r in wavelet.occurrences(manifest, folder, 1).collect() for p in r["places"])
    assert ends == [r["start"] + len(r["ids"]) // 4 - 1 for r in got]
    facts = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in wavelet.digests(manifest, folder).collect()}
    assert facts == {(r["doc_id"], r["start"]): (len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in got}
    at, texts = 0, {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and ids == coders[tokens.WORD_END](texts[r["doc_id"]]) + [1]
        at += len(ids)


@pytest.mark.parametrize("n", [0, 1, 63, 511, 512, 513, 5000])
def test_wavelet_planes(n):
    rng = np.random.default_rng(n)
    for bit in (rng.random(n) < 0.3, np.zeros(n, bool), np.ones(n, bool)):
        plane, at = wavelet.Plane.build(bit), np.arange(n + 1)
        assert plane.rank(at).tolist() == np.concatenate([[0], np.cumsum(bit)]).tolist() and (plane.bits() == bit).all()
        assert plane.select(np.arange(bit.sum()), True).tolist() == np.flatnonzero(bit).tolist()
        assert plane.select(np.arange(n - bit.sum()), False).tolist() == np.flatnonzero(~bit).tolist()


def _fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(n: int, linked) -> list[int]:
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def test_simhash(docs, rows):
    fps = [_fingerprint(r[1]) for r in rows]
    root = _components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    low = defaultdict(list)
    for r, g in zip(rows, root):
        if r[0] is not None:
            low[g].append(r[0])
    want = Counter((r[0], f"{f:016x}", min(low[g], default=None)) for r, f, g in zip(rows, fps, root))
    got = simhash.near_dedup(docs, block=4).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == want


def test_simhash_links_of_close_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in base for k in (0, 2, 4, 5, 7)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").selectExpr("fp", "fp AS id", "0 AS z")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(nodes, block=8)).collect()}
    root = _components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for i in range(len(fps)):
        for j in range(i):
            assert (root[i] == root[j]) == (got.get(fps[i], fps[i]) == got.get(fps[j], fps[j]))


def test_keep_one_drops_near_copies(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(20):
        w = say(200)
        rows += [(2 * i, " ".join(w), "en"), (2 * i + 1, " ".join([*w[:100], "other", *w[101:]]), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == list(range(0, 40, 2))


def test_surrogates(spark):
    texts = [
        "Write to Mr. Anton Berg at anton.berg@example.org or +49 30 1234567.", "Mr. Berg again, anton.berg@example.org!", "Card 4111 1111 1111 1111, not 4111 1111 1111 1112.",
        "token=abcdEFGH12345678xyz at 10.0.200.17", "SSN 123-45-6789; Mrs. Clara BERG", "Г-н Иванов пишет", "plain words, nothing else", None, "",
    ]
    docs = spark.createDataFrame([(i, t, "r", 9) for i, t in enumerate(texts)], "doc_id long, text string, _row string, n_replaced long")
    got = {r["doc_id"]: r for r in surrogates.replace_personal_data(docs, b"k").collect()}
    assert len(got) == len(texts) and all(r["_row"] == "r" and r["n_replaced"] == 9 for r in got.values())
    for i in (6, 7, 8):
        assert got[i]["text"] == texts[i] and got[i]["n_replaced_"] == 0
    for gone in ("Anton", "anton.berg", "1234567", "4111 1111 1111 1111", "abcdEFGH12345678xyz", "10.0.200.17", "123-45-6789", "Clara", "BERG", "Иванов"):
        assert not any(gone in (r["text"] or "") for r in got.values())
    assert "4111 1111 1111 1112" in got[2]["text"]  # no valid card number
    mail = got[0]["text"].split(" at ")[1].split(" ")[0]
    assert mail.endswith(".org") and mail in got[1]["text"]  # one person, one surrogate
    name = got[0]["text"].split(" at ")[0].split()[-1]
    assert f"Mr. {name} again" in got[1]["text"] and got[4]["text"].endswith(name.upper())
    assert all("Ѐ" <= c <= "ӿ" for c in got[5]["text"].split()[1])
    digits = [int(c) for c in got[2]["text"].split(",")[0] if c.isdigit()]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    assert Counter(map(tuple, got.values())) == Counter(map(tuple, surrogates.replace_personal_data(docs, b"k").collect()))


def test_surrogates_stay_distinct(spark):
    found = spark.range(900).selectExpr("'ssn' AS kind", "lpad(string(1000000 + (id % 450) * 1237), 7, '0') AS canon").union(spark.sql("SELECT 'ip', '1.2.3.4'"))
    made = surrogates.draw_surrogates(found, b"k").where("kind = 'ssn'").collect()
    assert len(made) == 450 == len({r["made"] for r in made}) and not {r["made"] for r in made} & {r["canon"] for r in made}


PAGES = [
    "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>Head &amp; more</h1><p>One\n  <b>two</b></p><div class='ad-box'>Buy</div><p>three<br>four</p></article><footer>foot</footer></body></html>",
    "<body><div class='cookie-notice'>We use cookies</div><p>Only <i>this</i> &lt;text&gt;</p><script>if (a<b) x()</script><section id=comments><p>me too</p></section>",
    None, "", "no markup at all", "<p>cut off <b>here",
]


def test_html_main_text(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(PAGES)] + [(3, None, "")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["text"]) for r in html_main.main_text(pages).collect()), key=str)
    assert got == [(0, "Head & more\nOne two\nthree four"), (1, "Only this <text>"), (2, ""), (3, ""), (3, ""), (4, "no markup at all"), (5, "cut off here")]


def test_html_templates_are_deduced(spark):
    rows = [(i, "http://one/x", f"<html><head><title>t</title></head><body><div><p>Same line on each page</p><p>Also here</p></div><div><p>text {i} of its own</p></div></body></html>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_main.main_text(pages).collect()} == {f"text {i} of its own" for i in range(12)}


def test_warc_round_trip(spark):
    body = "<html>" + "long enough " * 20
    rows = [(0, "u0", None), (1, "u\n1%0A", body), (2, "u2", body), (3, "u3", "short"), (4, "u4", "short"), (5, None, body), (6, "u6", "é" * 60), (7, "", ""), (6, "u6", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = new_path(spark, "warc")
    warc.archive(pages, path)
    got = warc.read_archive(spark, path).collect()
    assert Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in got) == Counter([(0, "u0", "response", None), (1, "u\n1%0A", "response", None), (2, "u2", "revisit", 1), (3, "u3", "response", None), (4, "u4", "response", None), (5, None, "revisit", 1), (6, "u6", "response", None), (6, "u6", "revisit", 6), (7, "", "response", None)])
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r["payload_bytes"] == len(texts[r["page_id"]]) and r["payload_digest"] == hashlib.sha256(texts[r["page_id"]]).hexdigest()
        assert r["payload"] == (None if r["record_type"] == "revisit" else texts[r["page_id"]])
    pushed = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit' AND page_id IN (1, 2)")
    assert [(r["page_id"], r["payload"]) for r in pushed.collect()] == [(2, None)]


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.keep_first(empty).count() == 0
    assert repetition.repetition_rules(empty).count() == repetition.keep_unrepetitive(empty).count() == 0
    assert sharding.balanced_shards(empty).count() == mixing.mixed_documents(empty).count() == packing.pack(empty).count() == 0
    assert simhash.near_dedup(empty).count() == simhash.keep_one(empty).count() == surrogates.replace_personal_data(empty, b"k").count() == 0
    folder = new_path(spark, "shards")
    assert wavelet.read_shards(materialize(wavelet.write_shards(empty, folder), "manifest"), folder).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.main_text(pages).count() == 0
    path = new_path(spark, "warc")
    warc.archive(pages, path)
    assert warc.read_archive(spark, path).count() == 0
