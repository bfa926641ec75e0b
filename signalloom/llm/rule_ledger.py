"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one bit per failed rule; a policy is a set of rules, i.e. a mask, so that any
number of versioned policies and all ablations are bit operations on the ledger
and never look at a text again.

Nulls are empty texts: they have no words, fail ``few_words`` only, and keep their
row.  An empty table gives an empty ledger.  Repeated rows are separate rows.  Texts of any length are
measured whole.  Columns of the input are only carried along when asked for, so names cannot clash.

The abuse rule is a list of English words.  The toxic rule reads marks that
:func:`learn` takes from labels, per language; without learnt marks it never fails.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.text import add_once
from signalloom.llm.common import hinted, hints_of, text_of, words_of
from signalloom.session import discard, written

SYMBOLS = "#*$%&|<>"
#: Words that attack a person; a parameter of the ledger.
ABUSE = ("stupid", "idiot", "moron", "trash", "scum", "pathetic", "disgusting", "worthless", "loser", "clown", "imbecile")


_PLACE = 30  # bits of a window's place in the text; the 34 above them hold a hash


def _maybe_repeated(packed: Column) -> Column:
    """Places of all windows whose 34-bit hash is not alone: every repeated one, and few others."""
    hashed = lambda i: F.shiftright(F.get(packed, i), _PLACE)
    pair = F.filter(
        packed,
        lambda x, i: F.coalesce(F.shiftright(x, _PLACE) == hashed(i - 1), F.lit(False))
        | F.coalesce(F.shiftright(x, _PLACE) == hashed(i + 1), F.lit(False)),
    )
    return F.transform(pair, lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1).cast("long")).cast("int"))


def _repeated_words(grams: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    ``grams`` is sorted by window, so equal windows are neighbours.  Their starts,
    in order, cover three words each less what the one before has covered.
    """
    gram = lambda i: F.get(grams, i)["gram"]
    twice = F.filter(grams, lambda x, i: x["gram"].eqNullSafe(gram(i - 1)) | x["gram"].eqNullSafe(gram(i + 1)))
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("words"), F.lit(-9).alias("last")),
        lambda acc, at: F.struct((acc["words"] + F.least(F.lit(3), at - acc["last"])).alias("words"), at.alias("last")),
        lambda acc: acc["words"],
    )
    return covered.cast("long")


_RUNS = (3, 4, 5, 6, 7, 8)  # lengths of leading character runs
_PARTS = 4  # each part of the labelled rows is scored by marks of the others
_VOTE = 1 << 27  # a text's vote, shared by its copies; whole numbers, so that sums do not depend on their order
_CELLS = 1024
_SALTS = 16


class Marks(NamedTuple):
    """One language's marks of toxic texts: (run, whole word or leading run, weight), and the score above which a text is toxic."""

    weights: tuple[tuple[str, bool, float], ...]
    threshold: float


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _score(text: Column, n_words: Column, weights: tuple[tuple[str, bool, float], ...]) -> Column:
    """Weights of the text's marked words, each by its heaviest mark, over its words and 20 more."""
    firsts = "".join(sorted({run[0] for run, _, _ in weights}))
    marks = "|".join(run + (r"(?!\p{L})" if whole else r"\p{L}*+") for run, whole, _ in sorted(weights, key=lambda m: (m[1], m[0])))
    hits = F.regexp_extract_all(F.lower(text), F.lit(rf"(?=[{firsts}])(?<!\p{{L}})(?:{marks})"), F.lit(0))
    known = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(w).alias("whole"), F.lit(x).alias("weight")) for r, w, x in weights])
    heaviest = lambda hit: F.array_max(
        F.transform(F.filter(known, lambda m: F.when(m["whole"], hit == m["run"]).otherwise(F.startswith(hit, m["run"]))), lambda m: m["weight"])
    )
    return F.aggregate(hits, F.lit(0.0), lambda acc, hit: acc + heaviest(hit)) / (n_words + 20)


def _votes(rows: DataFrame) -> DataFrame:
    """``rows`` of ``lang, toxic, text, n_words`` with ``part`` and ``vote``: all copies and near copies of a class share a part and one vote.

    Near copies are rows with the same least hash of four words in a row, which two texts have as often as such runs are common to them.
    """
    word = lambda i: F.get("words", i)
    runs = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 3, F.lit(0))), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2), word(i + 3)))
    least = add_once(rows.withColumn("words", words_of(F.col("text"))), {"least": F.coalesce(F.array_min(runs), F.xxhash64("text"))})
    told = written(
        least.select(
            "lang", "toxic", "text", F.size("words").alias("n_words"), F.pmod("least", F.lit(_PARTS)).cast("int").alias("part"),
            F.xxhash64("least", "lang", "toxic").alias("copies"),
        ), "toxic-labelled",
    )
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(_SALTS)]))  # many copies are dealt to several tasks
    many = written(told.groupBy("copies").agg(F.count("*").alias("n")).where("n > 1"), "toxic-copies")
    hints = hints_of(many, "copies")
    voting = hinted(told, hints).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))).join(many.select("copies", "n", salts.alias("salt")), ["copies", "salt"], "left")
    vote = (F.lit(_VOTE) / F.coalesce("n", F.lit(1))).cast("long")
    columns = ["lang", "toxic", "text", "n_words", "part"]
    alone = hinted(told, hints, there=False).select(*columns, F.lit(_VOTE).cast("long").alias("vote"))
    out = written(voting.select(*columns, vote.alias("vote")).unionByName(alone), "toxic-votes")
    discard(told, many)
    return out


def _rank(scores: DataFrame, above: float) -> dict[str, float]:
    """By language, the least ``score`` that ``above`` of the rows at most exceed: exact, by counting ever narrower ranges."""
    told = scores.groupBy("lang").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    place = {r["lang"]: (r["n"] - 1 - int(above * r["n"]), r["lo"], r["hi"]) for r in told}
    while wide := {lang: x for lang, x in place.items() if x[1] < x[2]}:
        inside = F.coalesce(*[F.when((F.col("lang") == lang) & F.col("score").between(lo, hi), (F.col("score") - lo) / F.lit(hi - lo)) for lang, (_, lo, hi) in wide.items()])
        cells = scores.withColumn("inside", inside).where("inside IS NOT NULL").groupBy("lang", F.least(F.lit(_CELLS - 1), F.floor(F.col("inside") * _CELLS)).alias("cell"))
        counts = cells.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
        for lang, (left, _, _) in wide.items():
            for r in sorted((r for r in counts if r["lang"] == lang), key=lambda r: r["cell"]):
                if left < r["n"]:
                    place[lang] = left, r["lo"], r["hi"]
                    break
                left -= r["n"]
    return {lang: lo for lang, (_, lo, _) in place.items()}


def learn(
    docs: DataFrame, labels: DataFrame, least: int = 20, surprise: float = 4.0, times: float = 2.0, clean_lost: float = 0.01,
) -> dict[str, Marks]:
    """Marks of toxic texts by language, from ``doc_id, text, lang`` and ``doc_id, toxic``.

    All labelled rows are read; labels that contradict each other count as toxic, rows without label are not read.
    A feature is a word or a leading run of 3 to 8 letters; its weight is the log of how much oftener toxic texts hold
    such words (each different word of a text once), per word of text, where copies and near copies have one vote together.
    It stays if that is ``times`` as often or more and
    ``surprise`` standard errors from as often, and if no shorter run weighs about as much.  The threshold is the least score
    that ``clean_lost`` of all clean rows at most exceed; each row is scored for it by marks of the other three parts in four
    of the rows (copies share a part).  A language with fewer than ``least`` toxic or clean rows has no marks.
    """
    toxic = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = F.col("doc_id").cast("string").alias("told")  # the two tables may hold ids of different types
    toxic = written(toxic.select("doc_id", "toxic", told), "toxic-labels")
    hints = hints_of(toxic, "told")
    given = hinted(docs.select("doc_id", told, _lang(docs).alias("lang"), text_of().alias("text")), hints).drop("told")
    rows = _votes(given.join(toxic, "doc_id").select("lang", "toxic", "text"))
    discard(toxic)
    models = [None, *range(_PARTS)]  # of all rows, and of all but one part
    of = lambda t, part: (F.col("toxic") == t) & (F.lit(True) if part is None else F.col("part") != part)
    in_class = lambda value: [F.sum(F.when(of(t, m), value).otherwise(0)).alias(f"{'ct'[t]}{k}") for k, m in enumerate(models) for t in (0, 1)]
    sums = rows.groupBy("lang").agg(F.sum(F.col("toxic")).alias("toxic_rows"), F.count("*").alias("rows"), *in_class(F.col("vote") * F.col("n_words")))
    totals = {r["lang"]: r for r in sums.where((F.col("toxic_rows") >= least) & (F.col("rows") - F.col("toxic_rows") >= least)).collect()}
    if not totals:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    held = rows.where(F.col("lang").isin(*totals)).select("lang", "toxic", "part", "vote", F.explode(words).alias("word"))
    held = held.groupBy("lang", "toxic", "part", "word").agg(F.sum("vote").alias("vote"))
    runs = [F.when(F.char_length("word") >= k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in _RUNS]
    each = held.select("lang", "toxic", "part", "vote", F.explode(F.array_compact(F.array("word", *runs))).alias("feature"))
    counted = each.groupBy("lang", "feature").agg(*in_class(F.col("vote"))).where(F.col("t0") >= 3 * _VOTE)

    def weighed(k: int) -> Column:
        """The feature's weight in a model, null if it isn't sure."""
        t, c = F.col(f"t{k}") / _VOTE + 0.5, F.col(f"c{k}") / _VOTE + 0.5
        size = lambda x: F.coalesce(*[F.when(F.col("lang") == lang, F.lit(math.log(r[f"{x}{k}"] / _VOTE) if r[f"{x}{k}"] else None).cast("double")) for lang, r in totals.items()])
        weight = F.log(t) - size("t") - F.log(c) + size("c")
        return F.when((F.col(f"t{k}") >= 3 * _VOTE) & (weight >= F.greatest(F.lit(math.log(times)), surprise * F.sqrt(1 / t + 1 / c))), weight)

    sure = counted.select("lang", "feature", *[weighed(k).alias(f"w{k}") for k in range(len(models))])
    sure = sure.where(F.coalesce(*[F.col(f"w{k}") for k in range(len(models))]).isNotNull()).collect()
    whole, *rest = [{lang: _marked({r["feature"]: r[f"w{k}"] for r in sure if r["lang"] == lang and r[f"w{k}"] is not None}) for lang in sorted(totals)} for k in range(len(models))]
    weights = {lang: marks for lang, marks in whole.items() if marks}
    if not weights:
        return {}
    others = {(lang, part): marks[lang] for part, marks in enumerate(rest) for lang in weights if marks[lang]}
    known = [F.when((F.col("lang") == lang) & (F.col("part") == part), _score(F.col("text"), F.col("n_words"), w)) for (lang, part), w in others.items()]
    clean = rows.where((F.col("toxic") == 0) & F.col("lang").isin(*weights))
    scores = written(clean.select("lang", F.coalesce(*known, F.lit(0.0)).alias("score")), "toxic-scores")
    discard(rows)
    return {lang: Marks(weights[lang], limit) for lang, limit in _rank(scores, clean_lost).items()}


def _marked(sure: dict[str, float]) -> tuple[tuple[str, bool, float], ...]:
    """Marks of the features that add something to their leading runs."""
    mine: dict[tuple[str, bool], float] = {}
    for feature in sorted(sure, key=lambda f: (len(f.rstrip("*")), f[-1] != "*", f)):
        run = feature.rstrip("*")
        if all(mine.get((run[:k], False), -math.inf) < sure[feature] - math.log(2) for k in range(_RUNS[0], len(run) + 1)):
            mine[run, not feature.endswith("*")] = sure[feature]
    return tuple((run, whole, x) for (run, whole), x in mine.items())


def _by_lang(lang: Column, values: dict, column) -> Column:
    """``column(value)`` of the row's language; null for other languages."""
    return F.coalesce(*[F.when(lang == name, column(v)) for name, v in values.items()])


def measure(
    docs: DataFrame, abuse: tuple[str, ...] = ABUSE, keep: tuple[str, ...] = ("doc_id",), marks: dict[str, Marks] | None = None,
) -> DataFrame:
    """``keep`` columns and the measurements all rules read, in one pass over the texts.

    With ``marks`` also ``toxicity``: the toxic score less the threshold of the row's language, null without marks for it.

    Repeated windows are found among sorted 64-bit numbers first; only those whose
    hash has company are compared as text, so the count is exact.
    """
    text = add_once(docs.select(*keep, text_of().alias("_text"), _lang(docs).alias("_lang")), {"_words": words_of(F.col("_text"))})
    word = lambda i: F.get("_words", i)
    packed = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.shiftleft(F.xxhash64(w, word(i + 1), word(i + 2)), _PLACE).bitwiseOR(i.cast("long")),
    )
    hashed = add_once(text, {"_packed": F.sort_array(packed)})
    windows = F.transform(
        _maybe_repeated(F.col("_packed")),
        lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("gram"), i.alias("at")),
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    attack = rf"(?i)(?<![a-z])(?=[{''.join(sorted({w[0] for w in abuse}))}])(?:{'|'.join(abuse)})(?![a-z])" if abuse else None
    above = lambda m: _score(F.col("_text"), F.size("_words"), m.weights) - m.threshold
    toxicity = [] if marks is None else [(_by_lang(F.col("_lang"), marks, above) if marks else F.lit(None).cast("double")).alias("toxicity")]
    return add_once(hashed, {"_grams": F.sort_array(windows), "_lines": lines}).select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_grams")).alias("n_repeat_words"),
        (F.regexp_count("_text", F.lit(attack)) if abuse else F.lit(0)).cast("long").alias("n_abuse"),
        *toxicity,
    )


def rules() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * n,
        "symbols": 10 * c("n_symbols") > 4 * n,
        "repeated_lines": 100 * c("n_dup_lines") > 40 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n),
        "abuse": (c("n_abuse") >= 2) & (250 * c("n_abuse") > n),
        "toxic": F.coalesce(c("toxicity") > 0, F.lit(False)),
    }


RULE_NAMES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "abuse", "toxic")
#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": RULE_NAMES[:6],
    "v2": RULE_NAMES,  # reads learnt marks
}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    return sum(1 << RULE_NAMES.index(name) for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(measured: DataFrame) -> DataFrame:
    """The measurements and ``failed``, one bit per failed rule; without ``toxicity`` among them its rule does not fail."""
    known = [(name, failed) for name, failed in rules().items() if name != "toxic" or "toxicity" in measured.columns]
    bits = [F.when(failed, F.lit(1 << RULE_NAMES.index(name)).cast("long")).otherwise(F.lit(0).cast("long")) for name, failed in known]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def rejected(policy: str | tuple[str, ...], failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(kept_ledger: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """Per rule of the policy: how many documents fail it, fail nothing else, and stay if it alone were dropped.

    The ledger is first counted by bit pattern (2**rules rows at most, combined before the shuffle).
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(policy)
    patterns = kept_ledger.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("docs"))
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in names]))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0).cast("long"))
    return (
        patterns.select("bits", "docs", each)
        .groupBy("rule")
        .agg(total(hit).alias("n_failed"), total(alone).alias("n_only"), total((F.col("bits") == 0) | alone).alias("n_kept_without"))
    )


def apply_rules(docs: DataFrame, policy: str | tuple[str, ...] = "v1", marks: dict[str, Marks] | None = None) -> DataFrame:
    """One row per document: measurements, failure bits, ``base_failed`` and ``kept`` under the policy."""
    marked = ledger(measure(docs, marks=marks))
    return marked.withColumn("base_failed", rejected("base")).withColumn("kept", ~rejected("base") & ~rejected(policy))


def keep_good(docs: DataFrame, policy: str | tuple[str, ...] = "v1", marks: dict[str, Marks] | None = None) -> DataFrame:
    """The documents the policy keeps, with all their columns, without a join."""
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text", _lang(docs).alias("lang"))
    judged = ledger(measure(row, keep=("_row",), marks=marks))
    return judged.where(~rejected("base") & ~rejected(policy)).select("_row.*")
