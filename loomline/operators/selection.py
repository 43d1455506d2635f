"""Selection under a budget: ordered choices per query over all its candidates, however many.

A choice in order of rank skips what doesn't fit, and what is spent only grows. So of the rows with equal tokens those
taken are the first ones, and no more than the choice can take at all: ``best_of_sizes`` leaves that many per query and
number of tokens (rows over the budget are one class), which bounds a query's list by the budget, not by the data. The
limit is taken inside the tasks before rows move. Rules that hang on other rows, too, get an aggregate of their own.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_of_sizes(rows: DataFrame, part: list[str], budget: int, keep: int) -> DataFrame:
    """The ``keep`` first rows, by score and id, of each part and number of tokens up to the budget, and of all over it."""
    order = Window.partitionBy(*part, "_size").orderBy(F.desc("score"), "id")
    sized = rows.withColumn("_size", F.least("tokens", F.lit(budget + 1)))
    return sized.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n", "_size")


def fold_budget(rows: DataFrame, budget: int, top_k: int, part: str = "query_id") -> DataFrame:
    """(part, place, id): rows by descending score while tokens last. A row that doesn't fit is skipped, or ends the
    selection once half of ``top_k`` is taken.

    The rows are chosen without the ending first; where it strikes is the least row that doesn't fit after half of them,
    one aggregate over all rows with the choice (``top_k`` rows a query) beside them.
    """
    ranked = F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))
    fits = best_of_sizes(rows.where(F.col("tokens") <= budget), [part], budget, top_k)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("t"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<s:double,id:bigint,used:bigint>>").alias("rows"))

    def step(acc, x):
        taken = (acc["used"] + x["t"] <= budget) & (F.size(acc["rows"]) < top_k)
        used = acc["used"] + x["t"]
        return F.struct(F.when(taken, used).otherwise(acc["used"]).alias("used"), F.when(taken, F.concat(acc["rows"], F.array(F.struct(x["s"].cast("double").alias("s"), x["id"].alias("id"), used.alias("used"))))).otherwise(acc["rows"]).alias("rows"))

    chosen = fits.groupBy(part).agg(ordered.alias("list")).select(part, F.aggregate("list", start, step)["rows"].alias("chosen"))
    before = F.filter("chosen", lambda c: (c["s"] < -F.col("score")) | ((c["s"] == -F.col("score")) & (c["id"] <= F.col("id"))))
    late = rows.join(chosen, part).withColumn("_before", before).where((F.size("_before") * 2 >= top_k) & (F.size("_before") < F.lit(top_k)))
    strikes = late.where((F.element_at("_before", -1)["used"] + F.col("tokens") > budget) & ~F.exists("chosen", lambda c: c["id"] == F.col("id")))
    ends = strikes.groupBy(part).agg(F.min(ranked).alias("end"))
    kept = chosen.join(ends, part, "left").select(part, F.posexplode("chosen").alias("place", "c"), "end")
    return kept.where(F.col("end").isNull() | (F.col("c.s") < F.col("end.s")) | ((F.col("c.s") == F.col("end.s")) & (F.col("c.id") < F.col("end.id")))).select(part, "place", F.col("c.id").alias("id"))


def choose_floors_and_caps(rows: DataFrame, budget: int, top_k: int, part: str = "query_id", file_floor: int = 2, section_cap: int = 4) -> DataFrame:
    """``floors_and_caps`` over all candidates: the first rows of files, of sections and of all, by size, decide."""
    place = F.row_number().over(Window.partitionBy(part, "file").orderBy(F.desc("score"), "id"))
    floors = rows.withColumn("_turn", place).where(F.col("_turn") <= file_floor)
    lists = [best_of_sizes(floors.where(F.col("_turn") == n + 1).drop("_turn"), [part], budget, top_k) for n in range(file_floor)]
    lists += [best_of_sizes(rows, [part, "section"], budget, 2 * top_k), best_of_sizes(rows, [part], budget, 2 * top_k)]
    turns = [f.withColumn("phase", F.lit(n)) for n, f in enumerate(lists)]
    every = turns[0]
    for f in turns[1:]:
        every = every.unionByName(f)
    marked = every.groupBy(*rows.columns).agg(F.collect_set("phase").alias("phases"))
    return select_per_query(marked, lambda c: floors_and_caps(sorted(c, key=lambda x: x["id"]), budget, top_k, file_floor, section_cap), part)


def choose_packed(rows: DataFrame, budget: int, cap: int, part: str = "query_id") -> DataFrame:
    """``pack_context`` over all candidates: of rows with one text in one file the best decides, as all have its size."""
    first = rows.groupBy(part, "file", "text").agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col("score"), "id")).alias("r")).select("r.*")
    return select_per_query(best_of_sizes(first.where(F.col("tokens") <= budget), [part], budget, cap), lambda c: pack_context(c, budget, cap), part)


def choose_sufficient(rows: DataFrame, terms: set[str], part: str = "query_id", cap: int = 5, floor: int = 3) -> DataFrame:
    """``smallest_sufficient`` over all candidates: of rows that hold the same terms only the ``cap`` best can be taken."""
    wanted = F.array_sort(F.array_intersect("terms", F.array(*[F.lit(t) for t in sorted(terms)])))
    order = Window.partitionBy(part, "terms").orderBy(F.desc("score"), "id")
    some = rows.withColumn("terms", wanted).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    return select_per_query(some, lambda c: smallest_sufficient(c, terms, cap, floor), part)


def evict_blocks(rows: DataFrame, budget: int, protected: int = 4, part: str = "query_id", reach: int = 1024) -> DataFrame:
    """(part, place, id): context blocks in order of priority; over the budget, the lowest priorities leave first (the
    greatest ids first among equals), never ``protected`` ones.

    A block leaves if the tokens of all blocks, less those that leave before it, are over the budget: prefix sums. They
    go by buckets of one priority and ``reach`` ids, so a task orders one bucket, and one row per bucket is summed up.
    """
    keys = [part, "priority", "_bucket"]
    cut = rows.withColumn("_bucket", F.floor(F.col("id") / reach))
    free = F.when(F.col("priority") > protected, F.col("tokens")).otherwise(0)
    own = Window.partitionBy(*keys).orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(part).orderBy(F.desc("priority"), F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys).agg(F.sum(free).alias("_free"), F.sum("tokens").alias("_all"))
    base = sums.select(*keys, F.coalesce(F.sum("_free").over(later), F.lit(0)).alias("_base"), F.sum("_all").over(Window.partitionBy(part)).alias("_total"))
    gone = F.col("_base") + F.coalesce(F.sum(free).over(own), F.lit(0))
    kept = cut.join(base, keys).withColumn("_gone", gone).where((F.col("priority") <= protected) | (F.col("_total") - F.col("_gone") <= budget))
    counts = kept.groupBy(*keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(part).orderBy("priority", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return kept.withColumn("_place", place).join(first, keys).select(part, (F.col("_first") + F.col("_place") - 1).cast("int").alias("place"), "id")


def floors_and_caps(candidates: list[dict], budget: int, top_k: int, file_floor: int = 2, section_cap: int = 4) -> list[dict]:
    """First ``file_floor`` per file in turns, then up to ``section_cap`` per section, then by score; one budget."""
    ranked = sorted(candidates, key=lambda c: -c["score"])
    chosen: list[dict] = []
    spent = 0

    def take(c: dict) -> bool:
        nonlocal spent
        if c in chosen or (chosen and spent + c["tokens"] > budget):
            return False
        chosen.append(c)
        spent += c["tokens"]
        return True

    files: dict = defaultdict(list)
    for c in ranked:
        files[c["file"]].append(c)
    for turn in range(file_floor):
        for own in files.values():
            if len(chosen) < top_k and turn < len(own):
                take(own[turn])
    seen: dict = defaultdict(int)
    for c in ranked:
        if len(chosen) < top_k and seen[c["section"]] < section_cap and take(c):
            seen[c["section"]] += 1
    for c in ranked:
        if len(chosen) < top_k:
            take(c)
    return chosen


def pack_context(candidates: list[dict], budget: int, cap: int) -> list[dict]:
    """By score, exact repeats of a source's text out, rows that don't fit skipped, ``cap`` rows at most."""
    seen, chosen, spent = set(), [], 0
    for c in sorted(candidates, key=lambda c: (-c["score"], c["id"])):
        mark = (c["file"], c["text"].strip())
        if mark in seen or spent + c["tokens"] > budget or len(chosen) >= cap:
            continue
        seen.add(mark)
        chosen.append(c)
        spent += c["tokens"]
    return chosen


def smallest_sufficient(candidates: list[dict], terms: set[str], cap: int = 5, floor: int = 3) -> list[dict]:
    """Greedy cover: the row that adds most terms not yet covered (then the better score) until all are covered,
    then by score up to ``floor`` rows; ``cap`` rows at most."""
    left, chosen, rest = set(terms), [], sorted(candidates, key=lambda c: (-c["score"], c["id"]))
    while left and rest and len(chosen) < cap:
        best = max(rest, key=lambda c: (len(left & set(c["terms"])), c["score"], -c["id"]))
        if not left & set(best["terms"]):
            break
        left -= set(best["terms"])
        chosen.append(best)
        rest.remove(best)
    while rest and len(chosen) < min(floor, cap):
        chosen.append(rest.pop(0))
    return chosen


def select_per_query(rows: DataFrame, choose, part: str = "query_id") -> DataFrame:
    """(part, place, id): a Python choice over each query's candidates, which must be few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = choose(pdf.to_dict("records"))
        return pd.DataFrame({part: pdf[part].iloc[0], "place": range(len(chosen)), "id": [c["id"] for c in chosen]})

    return rows.groupBy(part).applyInPandas(run, f"{part} long, place int, id long")
