import random
import re

from pyspark.sql import functions as F

from signalloom.llm import rule_ledger as R

SCHEMA = "doc_id long, text string, _row string, failed int, n_words string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, x in enumerate(g) if g.count(x) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    plain = " ".join(f"word{i}" for i in range(60))
    return [None, "", " \n\t", "a", "a b", "a a a a", "x y z x y z q x y z", "a b a b", plain, plain, plain + " ***" * 70,
            "one two\none two\n \nthree", " ".join(f"w{i}" for i in range(5000)), "the idiot and moron " + plain, "a\x1cb \x0bc"]


def test_measurements_and_verdict(spark):
    rows = [(i, t, "r", 1, "n") for i, t in enumerate(texts())]
    out = {r["doc_id"]: r for r in R.apply_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts()):
        n, chars, symbols, dup, rep = brute(t)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), t
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
    assert out[8]["kept"] and not out[10]["kept"] and not out[13]["kept"] and out[13]["base_failed"] is False


def test_policies_and_ablations_from_the_ledger(spark):
    ledger = spark.createDataFrame([(0,), (0,), (1,), (3,), (4,), (36,), (32,)], "failed long")
    assert ledger.where(~R.rejected("base")).count() == 5
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in R.ablations(ledger, "v1").collect()}
    assert got["few_words"] == (2, 1, 3) and got["symbols"] == (2, 1, 3) and got["abuse"] == (2, 1, 3) and got["repeated_words"] == (1, 0, 2)


def test_kept_documents_keep_their_columns(spark):
    rows = [(i, t, "r", 1, "n") for i, t in enumerate(texts())]
    given = spark.createDataFrame(rows, SCHEMA)
    out = R.keep_good(given)
    assert out.columns == given.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [8, 9, 12]
    assert R.apply_rules(given.limit(0)).count() == 0 and R.keep_good(given.where(F.lit(False))).count() == 0


def test_learnt_marks_find_toxic_texts_by_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    unseen = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)) == 0  # copies of a text fall on one side
    marks = R.learn(docs.where(~unseen), labels)
    judged = R.apply_rules(docs.where(unseen), "v2", marks).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    failed = F.col("failed").bitwiseAND(F.lit(R.mask(("toxic",)))) != 0
    got = {(r["lang"], r["toxic"]): (r["n"], r["hit"]) for r in judged.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum(failed.cast("int")).alias("hit")).collect()}
    print(got)
    for lang in ("en", "de", "fr", "es"):
        n, hit = got[lang, 1]
        assert n >= 3 and hit >= 0.75 * n, (lang, got)
        n, hit = got[lang, 0]
        assert hit <= 0.05 * n, (lang, got)


def test_no_marks_without_labels(spark):
    docs = spark.createDataFrame([(i, t, "r", 1, "n") for i, t in enumerate(texts())], SCHEMA)
    none = R.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert none == {}
    rows = R.apply_rules(docs, "v2", none).collect()
    assert all(r["failed"] & R.mask(("toxic",)) == 0 for r in rows) and sum(r["kept"] for r in rows) == 3


def test_marks_are_learnt_from_all_labelled_rows(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    say = lambda *more: " ".join([*(rng.choice(known) for _ in range(30)), *more])
    rows = [(say("zzwicked") if i % 40 == 0 else say("yyvile"), 1) for i in range(4000)]  # 100 of 4,000: too few in a sample of 1,000
    rows += [(say("xxplain"), 0) for _ in range(4000)]
    rows += [(f"{say()} zzwicked", 0)] * 6  # too few to move the threshold, one vote together
    rows += [("wworphan " + " ".join(known[:40]), 1)] * 300 + [("wworphan " + " ".join(known[:40]) + f" n{i}", 1) for i in range(300)]  # copies and near copies
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, toxic) for i, (_, toxic) in enumerate(rows)], "doc_id long, toxic int")
    marks = R.learn(docs, labels)
    found = {run for run, _, _ in marks["en"].weights}
    assert any("zzwicked".startswith(run) for run in found) and any("yyvile".startswith(run) for run in found), found
    assert not any("wworphan".startswith(run) or "xxplain".startswith(run) for run in found), found
    failed = F.col("failed").bitwiseAND(F.lit(R.mask(("toxic",)))) != 0
    judged = R.apply_rules(docs, "v2", marks).where(failed).join(labels, "doc_id").groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in judged}[1] == 4000 and {r["toxic"]: r["count"] for r in judged}.get(0, 0) <= 40


def test_threshold_is_the_exact_score_of_its_place(spark):
    rng = random.Random(5)
    scores = {"en": [rng.random() ** 9 for _ in range(5000)] + [0.0] * 300, "de": [0.25] * 7, "fr": [1e-300, 0.5, 2.0], "es": [rng.choice((0.0, 0.1, 0.1 + 2**-56, 0.3)) for _ in range(400)]}
    rows = spark.createDataFrame([(lang, x) for lang, values in scores.items() for x in values], "lang string, score double").repartition(4)
    for above in (0.0, 0.01, 0.3):
        assert R._rank(rows, above) == {lang: sorted(v)[len(v) - 1 - int(above * len(v))] for lang, v in scores.items()}
