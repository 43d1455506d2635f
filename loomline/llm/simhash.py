"""SimHash near-dedup by segment-popcount embedding.

Fingerprints are 64 bits over 4-word shingles. A fingerprint is embedded as the bit counts of its segments; the
Manhattan distance of two embeddings is never above the Hamming distance of the fingerprints. The different
fingerprints (copies are gathered first) are laid out in a grid of 16-bit segment counts. Cells whose centres are
within the threshold in Manhattan distance are joined, in blocks: a block holds about ``block`` fingerprints of one
cell, and a pair of blocks is compared in one vectorised step, first by the counts of finer segments (8 bits, a
tighter lower bound), then exactly. A pair of blocks returns a spanning forest of its links, never all pairs of a
group. Components come from repeated joins of minima, written as tables between rounds, up to the fixed point.

``keep_one`` drops near copies: the links of the fingerprints (of five-word shingles) propose pairs, the Jaccard
similarity of the whole shingle sets decides. Fingerprints alone miss pairs near the threshold, so an exact prefix
join proposes all pairs that are left; none with the similarity asked for is missed.

Null and wordless texts have fingerprint zero and are linked like any other; a very long text costs 16 bytes a word.
Repeated rows share a component; rows with a null id take part, and a component's id is the smallest id that is not
null (null if there is none). An empty table gives an empty result. ``near_dedup`` ignores other columns, whatever
their names; ``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.llm.common import bloom, discard, materialize, slices, table, whole_row

SEED, SHINGLE, DISTANCE, BLOCK = 42, 4, 4, 1024
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORDS = [f"w{k}" for k in range(8)]
COUNTED, FILTER_BITS = 512, 24  # shingles from which a set's classes are counted; bits of the filter of wanted ids


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() lowers A-Z only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - k + 1
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            for part in slices(batch, 1):
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segments(fp, bits: int) -> list:
    mask = (1 << bits) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(mask))) for at in range(0, 64, bits)]


def _offsets(distance: int, width: int) -> list[tuple[int, ...]]:
    """Steps between grid cells that points within the distance can lie in: one of each two opposite steps, and none."""
    cost = lambda d: 0 if d == 0 else width * (abs(d) - 1) + 1  # noqa: E731  least distance of points so many cells apart
    reach = [d for d in range(-(16 // width) - 1, 16 // width + 2) if cost(d) <= distance]
    steps: list[tuple[int, ...]] = [()]
    for _ in range(4):
        steps = [(*s, d) for s in steps for d in reach if sum(map(cost, s)) + cost(d) <= distance]
    return [s for s in steps if s >= (0, 0, 0, 0)]


def _forest(x: np.ndarray, y: np.ndarray, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of a spanning forest of the links between two blocks (or inside one)."""
    fine = lambda v: np.bitwise_count(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8)).astype(np.int8)
    fx, fy = fine(x), fine(y)
    found_i, found_j = [], []
    for at in range(0, len(x), 64):
        some = x[at : at + 64]
        bound = np.zeros((len(some), len(y)), np.int16)
        for k in range(8):
            bound += np.abs(fx[at : at + 64, None, k] - fy[None, :, k])
        i, j = np.nonzero(bound <= distance)
        hit = np.bitwise_count(some[i] ^ y[j]) <= distance
        if same:
            hit &= at + i < j
        found_i.append(at + i[hit])
        found_j.append(j[hit])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    shift = 0 if same else len(x)
    parent = list(range(len(x) + shift + len(y)))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    keep = []
    for n, (a, b) in enumerate(zip(i.tolist(), (j + shift).tolist())):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            keep.append(n)
    return i[keep], j[keep]


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): ids of linked nodes (fp, id); their components are those of all pairs within the distance."""
    width = max(1, distance - 3)
    keys = ["c0", "c1", "c2", "c3"]
    cells = nodes.select("fp", "id", *[F.floor(x / width).cast("int").alias(f"c{k}") for k, x in enumerate(_segments(F.col("fp"), 16))])
    # Blocks by a hash: a crowded cell is cut into even shares, and no task gathers a cell.
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    cells = cells.join(F.broadcast(sizes), keys)  # 17**4 cells at most
    cells = cells.withColumn("blk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).cast("int"))
    blocks = materialize(cells.groupBy(*keys, "blk").agg(F.collect_list("fp").alias("fps"), F.collect_list("id").alias("ids")), "blocks")
    # Which blocks meet is found by their numbers alone; the fingerprints follow.
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{k}") for k, v in enumerate(o)]) for o in _offsets(distance, width)])
    names = blocks.select(*keys, "blk")
    near = names.withColumn("s", F.explode(steps)).select(F.col("blk").alias("lblk"), *[F.col(k).alias(f"l{k}") for k in keys], *[(F.col(k) + F.col(f"s.d{n}")).cast("int").alias(k) for n, k in enumerate(keys)])
    here = F.lit(True)
    for k in keys:
        here = here & (F.col(f"l{k}") == F.col(k))
    near = near.join(names, keys).where(~here | (F.col("lblk") <= F.col("blk")))
    left = blocks.select(*[F.col(k).alias(f"l{k}") for k in keys], F.col("blk").alias("lblk"), F.col("fps").alias("x"), F.col("ids").alias("xi"))
    right = blocks.select(*keys, "blk", F.col("fps").alias("y"), F.col("ids").alias("yi"))
    pairs = near.join(left, [*[f"l{k}" for k in keys], "lblk"]).join(right, [*keys, "blk"])
    pairs = pairs.select("x", "xi", "y", "yi", (here & (F.col("lblk") == F.col("blk"))).alias("same"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                x, xi, y, yi = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
                i, j = _forest(x.view(np.uint64), y.view(np.uint64), distance, batch.column(4)[k].as_py())
                out_a.append(xi[i])
                out_b.append(yi[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_a, out_b)], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node reachable (large-star and small-star rounds).

    Each round replaces edges by edges to minima; hubs are aggregated before they are joined, and Spark splits the
    skewed side of the joins. Every round is a written table; rounds end when one changes nothing, after a number that
    grows with the logarithm of the longest path.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node hang on its minimum
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct(), "large")
        # small star: neighbours below a node hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = materialize(small.where("a <> b").distinct(), "edges")
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark(after) == mark(edges):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def near_dedup(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    edges = links(groups.select("fp", F.col("fp").alias("id")), distance, block)
    roots = components(edges)
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(named.join(lowest, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The sorted different shingle hashes of a text; a wordless text has the one hash 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    k = min(shingle, len(words))
    n = len(words) - k + 1
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    rolled = each[:n].copy()
    for at in range(1, k):
        rolled = rolled * MULTIPLIER + each[at : at + n]  # modulo 2**64
    return np.unique(rolled)


def _rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many (text, shingle) pairs fall into each of 2**16 buckets of shingle hashes: of a fixed size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    counts += np.bincount(_bucket(shingle_hashes(t, shingle)), minlength=1 << 16)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    out = np.zeros(1 << 16, np.int64)
    counted = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """512 bits, as 8 numbers: which of 512 classes hold an odd number of the hashes. Where two sets differ in d hashes,
    their bits differ in d places at most."""
    odd = np.bincount((hashes >> np.uint64(7) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _class_counts(hashes: np.ndarray) -> bytes | None:
    """For a large set of n hashes: how many fall into each of 2**k classes, n/4 to n/2 in number, modulo 256."""
    if len(hashes) < COUNTED:
        return None
    classes = 1 << (len(hashes).bit_length() - 2)
    return np.bincount((hashes >> np.uint64(7) & np.uint64(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8).tobytes()


def _least_apart(x: bytes, y: bytes) -> int:
    """So many hashes at least differ between two sets with these counts. Parity bits can't say more than 512, and say
    256 of any two large sets; counts grow with the sets."""
    p, q = sorted((np.frombuffer(c, np.uint8) for c in (x, y)), key=len)
    apart = p - q.reshape(-1, len(p)).sum(axis=0, dtype=np.uint8)  # of the smaller number of classes; modulo 256
    return int(np.minimum(apart, np.negative(apart)).sum(dtype=np.int64))


def _prefixes(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(id, n, toks, w0 to w7, counts): of each set of n shingles the rarest, so many that two sets as similar as
    ``least`` share one, and the set's parity bits and class counts.

    All sets are ordered alike, by the count of a shingle's bucket and then its hash. Any such order is exact; this one
    leaves shared passages out of the prefixes, as their buckets stand out.
    """
    rarity = _rarity(texts, shingle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for whole in batches:
            for batch in slices(whole, 1):
                sizes, toks, bits, counts = [], [], [], []
                for t in batch.column(1).to_pylist():
                    hashes = shingle_hashes(t, shingle)
                    n = len(hashes)
                    toks.append(hashes[np.lexsort((hashes, rarity[_bucket(hashes)]))[: n - int(np.ceil(least * n - 1e-9)) + 1]].view(np.int64))
                    sizes.append(n)
                    bits.append(_parity(hashes))
                    counts.append(_class_counts(hashes))
                ends = np.cumsum([0, *map(len, toks)]).astype(np.int32)
                words = np.stack(bits, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, np.concatenate(toks)), *map(pa.array, words), pa.array(counts, pa.binary())], ["id", "n", "toks", *_WORDS, "counts"])

    return texts.select("id", F.col("text").cast("string")).mapInArrow(run, "id long, n int, toks array<long>, " + ", ".join(f"{w} long" for w in _WORDS) + ", counts binary")


def _shingle_sets(texts: DataFrame, shingle: int, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(id, hashes): the sorted different shingle hashes, as bytes, of each text whose ``id`` is wanted.

    Texts stay where they are: a filter of a fixed size goes to them. It lets some texts through that aren't wanted,
    and none that is wanted gets lost.
    """
    places = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << bits)) for k in range(2)]
    shared = texts.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.explode(F.array(*places)).alias("p")), bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(shared.value, np.uint32)
        for whole in batches:
            through = np.ones(whole.num_rows, bool)
            for c in (2, 3):
                p = whole.column(c).to_numpy()
                through &= (words[p >> 5] >> (p & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
            for batch in slices(whole.filter(pa.array(through)), 1):
                sets = [shingle_hashes(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "hashes"])

    return texts.select("id", F.col("text").cast("string"), *[p.alias(f"p{k}") for k, p in enumerate(places)]).mapInArrow(run, "id long, hashes binary")


def _within(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, most, x, y) whose class counts x and y don't say that more than ``most`` hashes differ."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_least_apart(x.as_buffer(), y.as_buffer()) <= most.as_py() for most, x, y in zip(*(batch.column(c) for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "most", "x", "y").mapInArrow(run, "a long, b long")


def _jaccard_at_least(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, x, y) of shingle sets that are as similar as ``least``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar(texts: DataFrame, least: float, shingle: int, distance: int = DISTANCE) -> DataFrame:
    """(node, root) as of ``components``, of the links between all texts (id, text) as similar as ``least``.

    First the cheap proposals: texts whose fingerprints are equal or linked in the grid, and each text with three texts
    per shared shingle of its prefix (those with the smallest hashes), which joins large groups by few comparisons.
    Then all pairs of texts that share a prefix shingle and aren't yet in one component, unless the first shared place
    or the parity bits rule them out. Every proposal that sizes, parity bits and the class counts of large sets allow is
    decided by the whole sets.
    """
    prefixes = materialize(_prefixes(texts, shingle, least), "prefixes")
    spread = prefixes.select("id", "n", F.posexplode("toks").alias("pos", "tok"))
    shared = spread.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    members = materialize(spread.join(shared, "tok"), "members")

    total = lambda m, n: (F.col(m) + F.col(n)) / (1 + least)  # noqa: E731  shingles that two sets can have in all
    fits = lambda m, n: F.least(m, n) >= F.greatest(m, n) * least - 1e-6
    apart = sum((F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in _WORDS), F.lit(0))
    most = total("na", "nb") * (1 - least) + 1e-6  # shingles that they can differ in
    alike = fits(F.col("na"), F.col("nb")) & (apart <= most)
    kind = [most.alias("most"), (F.least("na", "nb") >= COUNTED).alias("large")]

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, most, large) that sizes and parity bits don't rule out."""
        a, b = (prefixes.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", *_WORDS)]) for s in "ab")
        return pairs.join(a, "a").join(b, "b").where(alike).select("a", "b", *kind)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are similar. Class counts are moved for large sets first, and whole sets for what they leave."""
        proposed = materialize(pairs, "proposed")
        counts = prefixes.where(F.col("n") >= COUNTED).select("id", "counts")
        large = proposed.where("large").join(counts.select(F.col("id").alias("a"), F.col("counts").alias("x")), "a").join(counts.select(F.col("id").alias("b"), F.col("counts").alias("y")), "b")
        pairs = materialize(proposed.where("not large").select("a", "b").union(_within(large)), "close")
        discard(proposed)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        sets = materialize(_shingle_sets(texts, shingle, ends), "sets")
        joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        found = materialize(_jaccard_at_least(joined, least), "similar")
        discard(pairs, sets)
        return found

    marked = materialize(fingerprints(texts.select(F.col("id").alias("doc_id"), "text"), shingle), "fingerprints")
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "groups")
    linked = links(groups, distance)
    equal = marked.join(groups, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    centres = members.groupBy("tok").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("c"), F.col("n").alias("m"))).alias(f"z{k}") for k in range(3)])
    stars = members.join(centres, "tok").select("id", "n", F.explode(F.array("z0", "z1", "z2")).alias("z")).where(fits(F.col("n"), F.col("z.m"))).select(F.col("id").alias("a"), F.col("z.c").alias("b"))
    proposed = stars.union(linked).union(equal).where("a <> b")
    first = materialize(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    discard(marked, groups)
    edges = verified(likely(first))
    discard(first)

    roots = components(edges).withColumnRenamed("node", "id")
    placed = materialize(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "placed")
    discard(members)
    # Keys that hold one component only fall out before any rows are paired, or get their parity bits.
    many = placed.groupBy("tok").agg((F.min("root") != F.max("root")).alias("many")).where("many").select("tok")
    many_rows = materialize(placed.join(many, "tok"), "many")
    discard(placed)
    paired = many_rows.join(prefixes.select("id", *_WORDS), "id")
    side = lambda s: paired.select(*[F.col(c).alias(f"{c}{s}") for c in ("tok", "id", "n", "pos", "root", *_WORDS)])
    # Where a pair's first common shingle stands, all its common ones stand from there on; parity bits show differences.
    possible = alike & (F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= total("na", "nb") * least - 1e-6)
    pairs = side("a").join(side("b"), (F.col("toka") == F.col("tokb")) & (F.col("roota") < F.col("rootb")) & possible)
    more = verified(pairs.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"), *kind).distinct())
    discard(prefixes, many_rows)
    return components(edges.union(more))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The documents less near copies: one row of each group stays, that with the smallest id; columns unchanged.

    Groups are the components of all pairs of rows whose sets of ``shingle``-word shingles have a Jaccard similarity of
    ``similarity`` or more; none is missed. Rows equal in all columns are copies. Wordless texts are copies of each
    other. Rows are written once with a number of their own, by which they are known; null ids come last.
    """
    rows = materialize(docs.select(whole_row(docs)).withColumn("_number", F.monotonically_increasing_id()), "numbered")
    number, doc_id = F.col("_number"), F.col("_row.doc_id").cast("long")
    roots = similar(rows.select(number.alias("id"), F.col("_row.text").alias("text")), similarity, shingle)
    # Only rows with links are looked at: roots themselves and the rows that hang on them.
    grouped = materialize(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "grouped")
    named = rows.select(number.alias("node"), doc_id.alias("doc_id")).join(grouped, "node")
    stay = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")).alias("b")).select("root", F.col("b.node").alias("stays"))
    gone = materialize(grouped.join(stay, "root").where("node <> stays").select(F.col("node").alias("_number")), "gone")
    return rows.join(gone, "_number", "left_anti").select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
