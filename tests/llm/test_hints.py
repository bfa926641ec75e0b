import corpus_pipeline as P
from signalloom.llm import jaccard_join as J
from signalloom.llm import rule_ledger as R
from signalloom.llm.common import hinted, hints_of
from signalloom.session import written


def test_no_key_is_missed_and_few_others_pass(spark):
    rows = spark.range(20_000).selectExpr("nullif(id % 5000, 17) AS a", "concat('x', id % 7) AS b", "id").repartition(5)
    for wanted in (rows.where("id < 300"), rows.where("a IS NULL"), rows.limit(0), rows):
        wanted = written(wanted.select("a", "b"), "wanted")
        hints = hints_of(wanted, "a", "b")
        there, others = hinted(rows, hints), hinted(rows, hints, there=False)
        assert there.columns == others.columns == rows.columns
        keys = {tuple(r) for r in wanted.collect()}
        held = rows.collect()
        passed, kept = {r["id"] for r in there.collect()}, {r["id"] for r in others.collect()}
        assert passed | kept == set(range(20_000)) and not passed & kept
        asked = {r["id"] for r in held if (r["a"], r["b"]) in keys}
        assert asked <= passed and len(passed) <= len(asked) + 20_000 / 8


def test_texts_without_company_are_not_dealt_out(spark, monkeypatch):
    """Of texts, only those that a step asks for come to a shuffle."""
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(60))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)] + [(2000, rows[9][1]), (3, rows[3][1])]
    let: dict[str, list[int]] = {"J": [], "P": []}

    def counting(module, name):
        real = module.hinted

        def run(df, hints, there=True):
            out = real(df, hints, there)
            if there and {"text", "row"} & set(df.columns):
                let[name].append(out.count())
            return out

        monkeypatch.setattr(module, "hinted", run)

    counting(J, "J"), counting(P, "P")
    out = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(400))
    assert let["J"] and let["P"] and all(n <= 60 for name in let for n in let[name])


def test_texts_without_label_or_copy_are_not_dealt_out(spark, monkeypatch):
    """Labels may have ids of another type; only labelled texts, and of those only copies, come to a shuffle."""
    rows = [(i, "en", ("vile " if i % 10 == 0 else "good ") * 3 + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(600)]
    rows[7] = (7, "en", rows[1][2])
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 10 == 0) for i in range(300)], "doc_id int, toxic boolean")
    let, real = [], R.hinted

    def counting(df, hints, there=True):
        out = real(df, hints, there)
        if there:
            let.append(out.count())
        return out

    monkeypatch.setattr(R, "hinted", counting)
    marks = R.learn(docs, labels)
    assert [w for w, _, _ in marks["en"].weights] == ["vil"]
    assert 300 <= let[0] <= 340 and 2 <= let[1] <= 40
