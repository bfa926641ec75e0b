"""Texts are matched once: what is costly is written, and queries read that as often as they need."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from signalloom import fixed_values as V
from signalloom.functions import text as X
from signalloom.operators import entities as E

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["comment_relevance", "representative_comments"])
def test_comments_are_matched_once(spark, name):
    files = entry.queries()[name](spark, FOLDER).inputFiles()
    assert files and not any("conversations" in f for f in files)


@pytest.mark.parametrize("name", ["jaccard_similarity", "phrase_overlap", "event_relation", "token_union_intersect", "weighted_similarity", "cluster_score"])
def test_documents_are_cut_before_they_meet(spark, name):
    plan = plan_of(spark, name)
    assert "RLIKE" not in plan and "regexp" not in plan and "split" not in plan


def test_previews_read_written_signals(spark):
    assert "RLIKE" not in plan_of(spark, "latest_previews")


def test_phrases_of_any_length(spark):
    """A phrase of 60,000 words overflowed the stack."""
    df = spark.createDataFrame([("Foo Bar " * 30_000,), ("Foo Bar. J. K. " * 20_000 + "9",)], "t string")
    got = [r["p"] for r in df.select(X.name_phrases(F.col("t")).alias("p")).collect()]
    assert got == [[("foo bar " * 30_000).strip()], [("foo bar. j. k. " * 20_000).strip().removesuffix(". j. k.")]]


def test_phrases_equal_their_pattern(spark):
    rnd = random.Random(5)
    bits = ["A", "Bc", "D.", "E.f", "x", "9", "_", " ", "  ", "\t", ".", "..", "é", "Zz.", "Q.R.", "\n", "Foo", "J. "]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(1, 14))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.name_phrases(F.col("t")).alias("p")).collect():
        assert r["p"] == list(dict.fromkeys(m.lower() for m in re.findall(V.NAME_PHRASE, r["t"], re.ASCII)))


@pytest.mark.parametrize("first_words", [0, 1024])
def test_linked_terms_with_few_and_many_first_words(spark, monkeypatch, first_words):
    monkeypatch.setattr(E, "FIRST_WORDS", first_words)
    texts = spark.createDataFrame([(1, "The GPT-5 model's on, the rise"), (2, "gpt 4"), (3, None), (4, "a b c a b"), (5, "rise")], "k int, t string")
    terms = spark.createDataFrame([("g", "gpt 5"), ("m", "models on the"), ("r", "rise"), ("ab", "a b"), ("bca", "b c a"), ("n", "!")], "id string, term string")
    got = {tuple(r) for r in E.link_terms(texts, "k", "t", terms).collect()}
    assert got == {(1, "g"), (1, "m"), (1, "r"), (4, "ab"), (4, "bca"), (5, "r")}


def test_grams_are_made_where_a_longer_term_can_begin(spark):
    texts, terms = spark.createDataFrame([(1, "x y")], "k int, t string"), spark.createDataFrame([("a", "x y")], "id string, term string")
    assert "_begin" in E.link_terms(texts, "k", "t", terms)._jdf.queryExecution().analyzed().toString()
