"""Texts are cut into words once a row, and what scans score equals what the stored index scores."""

from __future__ import annotations

import pytest

import __spark_entry__
from loomline.functions import text
from loomline.operators import retrieval as r
from loomline.operators.postings import write_index

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["h4_all_terms", "h7_set_cosine", "h8_fuzzy_lexical", "h9_entity_fusion", "h23_question_gate", "h24_sufficiency", "h41_evidence_tiers"])
def test_words_are_cut_once(spark, name):
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert "[^a-z0-9-]+" not in plan


@pytest.mark.parametrize("name", ["e9_budget_fold", "e10_floors_and_caps", "h26_sufficient_set", "h33_pack_context", "h34_evict_blocks"])
def test_candidates_are_written(spark, name):
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    assert "regexp" not in frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["f3_fused_order", "h11_mode_hybrid", "h12_adaptive_threshold"])
def test_scored_without_an_index(spark, name, monkeypatch):
    from loomline.plans import retrieval

    monkeypatch.setattr(retrieval, "_index", lambda t: pytest.fail("built an index of all words"))
    assert __spark_entry__.queries()[name](spark, FOLDER).count() > 0


def test_tokens_of_odd_texts(spark):
    odd = ["The DOG’s bones, it's the dogs' ’s", "a-b --- x_y_zzz tab\tnew\nline é café", "", "İstanbul's ſchool 'sister's", "ab abc'd a’bc"]
    got = [x["w"] for x in spark.createDataFrame([(n, t) for n, t in enumerate(odd)], "n int, text string").orderBy("n").select(text.tokens("text").alias("w")).collect()]
    assert got == [r.query_terms(t) for t in odd]


def test_scan_scores_as_the_index(spark):
    rows = [(1, "the thing with the reason"), (1, "the other"), (2, "no word of it"), (3, ""), (4, "reason reason from")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = ["the", "reason", "the", "absent"]
    plain = lambda d, key: sorted((x[key], round(x["score"], 9)) for x in d.collect())
    assert plain(r.bm25_scan(docs, "doc_id", terms), "doc_id") == plain(write_index(docs).scores(terms), "key")
