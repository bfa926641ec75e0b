from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.text import literal_term_pattern, matches
from signalloom.operators import classify as C
from signalloom.operators import scoring as S
from signalloom.operators.entities import entity_activity, match_entities

FIRMS = [
    dict(id="bot", importance=100, match=["chatbot one"]), dict(id="chips", importance=96, match=["chipco", r"\bx\d00\b"]),
    dict(id="cloud", importance=80, match=["aws"]),
]


def rows(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_categorize(spark):
    cases = [
        ("Startup raises $5B at a new valuation", "capital"), ("New paper: researchers set SOTA benchmark", "research"),
        ("Regulators plan a new regulation in court", "policy"), ("New H200 GPU data center chip", "compute"),
        ("Firm launches new app feature update", "product"), ("CEO steps down amid layoffs", "orggov"),
        ("Nothing to see here", "general"),
    ]
    df = spark.createDataFrame([(t, None, c) for t, c in cases], "title string, desc string, want string")
    out = C.categorize(df).collect()
    assert [(r["category"], r["title"]) for r in out if r["category"] != r["want"]] == []
    assert {r["cat_confidence"] for r in out if r["category"] == "general"} == {0.3}
    by_title = {r["title"]: r["cat_confidence"] for r in out}
    assert by_title["New H200 GPU data center chip"] == 0.89  # 8 of 8 + 0 + 1


def test_actions(spark):
    texts = ["Acme is shutting down Comet", "The browser is already dead", "Acme launches a family", "Ada steps down", "raises $100M Series B", "quiet"]
    assert rows(spark, texts, C.extract_action) == ["shutdown", "shutdown", "launch", "resign", "raise", None]


def test_mentions(spark):
    def sure(text, key):
        return rows(spark, [text], lambda c: C.mention_confidence(c, V.MODEL_MATCHERS[key]))[0]

    assert sure("Hard to grok this codebase", "grok") == 0
    assert sure("Grok 4 reasons better", "grok") == 0.9
    assert sure("Grok gave a wrong answer to my LLM prompt", "grok") == 0.6
    assert sure("A llama walked into the barn", "llama") == 0
    assert sure("I run llama.cpp at home", "llama") == 0.9
    assert sure("the geminid meteor shower", "gemini") == 0
    assert abs(sure("Anthropic Claude Code writes tests", "claude") - 0.85) < 1e-9


def test_release_talk_topics_license_field(spark):
    assert rows(spark, ["It just dropped", "Now generally available", "is X better than Y?", None], C.is_release_discussion) == [True, True, False, False]
    assert rows(spark, ["cheap api to run locally"], C.classify_topics) == [["coding", "price", "local"]]
    assert rows(spark, ["Apache 2.0", "MIT License", "on Hugging Face", "closed"], lambda c: C.detect_license(c)["lic"]) == ["apache", "mit", "open weights", "see model card"]
    assert rows(spark, ["humanoid hands", "protein folding", "plain"], C.infer_field) == ["Robotics", "Biology", "Research"]
    assert rows(spark, ["Acme launches a phone", "Why Acme launches less", "Acme releases a kit"], lambda c: C.is_product_release(c, F.lit(None))) == [True, False, True]


def test_entities(spark):
    df = spark.createDataFrame(
        [("Chatbot One gets an update", None), ("ChipCo X900 and chatbot one", ""), ("A lawsuit", "x9000")], "title string, desc string"
    )
    linked = match_entities(df, FIRMS)
    got = [(r["entity_ids"], r["max_importance"]) for r in linked.collect()]
    assert got == [(["bot"], 100), (["bot", "chips"], 100), ([], 0)]
    dimension = spark.createDataFrame([(e["id"],) for e in FIRMS], "id string")
    assert dict(map(tuple, entity_activity(linked, dimension).collect())) == {"bot": 2, "chips": 1, "cloud": 0}
    assert literal_term_pattern("c++") == r"\bc\+\+\b"


def test_verification_and_caps(spark):
    data = [
        ("Plain report", "general", 80, 1, False), ("Plain report", "general", 80, 2, False), ("Acme is hiring", "product", 80, 1, False),
        ("Opinion", "analysis", 60, 5, True), ("It reportedly may have failed", "product", 50, 3, False), ("News", "product", 90, 1, True),
    ]
    df = spark.createDataFrame([(*d, None) for d in data], "title string, category string, significance int, source_count int, own boolean, desc string")
    df = df.withColumn("verification", C.classify_verification(F.col("title"), F.col("desc"), F.col("category"), F.col("source_count"), F.col("own")))
    out = C.apply_integrity_caps(df).select("verification", "significance", "impact", "cap_reason", "capped").collect()
    assert [tuple(r) for r in out] == [
        ("single", 55, "notable", "single-source-general", True), ("corroborated", 80, "high", None, False),
        ("single", 80, "notable", "job-or-speculative", True), ("analysis", 60, "notable", None, False),
        ("uncertain", 50, "notable", None, False), ("official", 90, "high", None, False),
    ]


def test_consequences(spark):
    df = spark.createDataFrame(
        [("Acme launches a phone", None, "product", "high", "official"), ("Startup raises a round", None, "capital", "emerging", "single"),
         ("Nothing", None, "general", "emerging", "single")],
        "title string, desc string, category string, impact string, verification string",
    )
    why = [r["why_it_matters"] for r in C.why_it_matters(df).collect()]
    assert why[0] == V.CONSEQUENCE_BY_ACTION["launch"]
    held = V.CONSEQUENCE_BY_ACTION["raise"]
    assert why[1] == V.WEAK_PREFIX + held[0].lower() + held[1:]
    assert why[2] == V.CONSEQUENCE_BY_CATEGORY["general"]  # already conditional


def test_scores(spark):
    at = F.lit("2026-07-08 00:00:00").cast("timestamp")
    got = spark.range(1).select(
        S.recency_score(at, "2026-07-09 00:00:00").alias("r"),
        S.significance(at, F.lit(3), F.lit(96), F.lit("compute"), F.lit(0.9), "2026-07-08 00:00:00").alias("s"),
        S.comment_completeness(F.lit("> quoted")).alias("q"),
        S.comment_completeness(F.lit("This is a full sentence that says what works well, and what does not, in some detail for you.")).alias("c"),
    ).first()
    assert abs(got["r"] - 2 / 3) < 1e-9
    assert got["s"] == 90  # 35 + 18.75 + 24 + 12
    assert got["q"] == 0 and abs(got["c"] - 0.85) < 1e-9


def test_patterns_compile_in_spark(spark):
    every = [p for rules in V.CATEGORY_RULES.values() for p, _ in rules] + [p for _, p in V.ACTION_RULES + V.FIELD_RULES + V.LAB_RULES]
    every += [t[2] for t in V.TOPICS] + [V.RELEASE_TALK, V.AI_CONTEXT, V.HEDGING, V.JOB_POSTING, V.SPECULATIVE, V.STRONG_OBJECTS, V.WEAK_OBJECTS]
    df = spark.createDataFrame([("plain words",)], "t string")
    assert len(df.select(*[matches(F.col("t"), p) for p in every]).first()) == len(every)
