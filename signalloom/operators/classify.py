"""Lexicon-driven classification.

Rules are compiled into literal expressions once per plan, so a whole lexicon is
evaluated in one pass over the rows and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.numbers import clamp, round_half_up
from signalloom.functions.text import add_once, find_nouns, headline_text, let, matches, name_phrases, pattern, with_headline


def first_match(text: Column, rules, lower: Column | None = None) -> Column:
    """Label of the first rule whose pattern occurs, else null."""
    out = F.lit(None).cast("string")
    for label, regex in reversed(list(rules)):
        out = F.when(matches(text, regex, lower=lower), F.lit(label)).otherwise(out)
    return out


def rule_total(text: Column, rules, lower: Column | None = None) -> Column:
    """Sum of the weights of all matching rules."""
    total = F.lit(0.0)
    for regex, weight in rules:
        total = total + F.when(matches(text, regex, lower=lower), F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def categorize(
    df: DataFrame,
    rules: dict = V.CATEGORY_RULES,
    minimum: float = V.MIN_CATEGORY_SCORE,
    fallback: str = V.FALLBACK_CATEGORY,
    fallback_confidence: float = V.FALLBACK_CONFIDENCE,
    title: str = "title",
    desc: str = "desc",
) -> DataFrame:
    """Add ``category`` and ``cat_confidence`` (dominance over the runner-up)."""
    text, lower = F.col("_text"), F.col("_lower")
    names = list(rules)

    def judged(totals: Column) -> Column:
        ranked = F.sort_array(totals, asc=False)
        top = ranked[0]
        second = ranked[1] if len(names) > 1 else F.lit(0.0)
        winner = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(totals, top).cast("int"))
        sure = round_half_up(clamp(top / (top + second + 1), 0.0, 1.0), 2)
        return F.struct(
            F.when(top < minimum, F.lit(fallback)).otherwise(winner).alias("category"),
            F.when(top < minimum, F.lit(fallback_confidence)).otherwise(sure).alias("cat_confidence"),
        )

    verdict = let(F.array(*[rule_total(text, rules[n], lower) for n in names]), judged)
    once = add_once(with_headline(df, title, desc), {"_v": verdict})
    return once.drop("category", "cat_confidence", "_text", "_lower").select("*", "_v.*").drop("_v")


def _lookup(key: Column, table: dict, default) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, key), F.lit(default))


def wave_family(category: Column, table: dict = V.CATEGORY_FAMILY, default: str = V.DEFAULT_FAMILY) -> Column:
    return _lookup(F.coalesce(category, F.lit("")), table, default)


def category_weight(category: Column) -> Column:
    return _lookup(F.coalesce(category, F.lit("")), V.CATEGORY_WEIGHT, V.DEFAULT_CATEGORY_WEIGHT)


def label_of(code: Column, labels: dict, default: str | None = None) -> Column:
    """Display label of a verification, impact or source code."""
    return _lookup(F.coalesce(code, F.lit("")), labels, default)


def extract_action(text: Column, rules=V.ACTION_RULES) -> Column:
    return first_match(text, rules)


def detect_lab(text: Column, rules=V.LAB_RULES, lower: Column | None = None) -> Column:
    return first_match(text, rules, lower)


def infer_field(text: Column, rules=V.FIELD_RULES, default: str = V.DEFAULT_FIELD) -> Column:
    return F.coalesce(first_match(text, rules), F.lit(default))


def detect_license(text: Column, rules=V.LICENSE_RULES, default=V.DEFAULT_LICENSE) -> Column:
    """Struct of licence name and licence class."""
    out = F.struct(F.lit(default[0]).alias("lic"), F.lit(default[1]).alias("lic_class"))
    for regex, name, group in reversed(list(rules)):
        hit = F.struct(F.lit(name).alias("lic"), F.lit(group).alias("lic_class"))
        out = F.when(matches(text, regex), hit).otherwise(out)
    return out


def classify_topics(text: Column, topics=V.TOPICS) -> Column:
    """Ids of all matching topics, in topic order."""
    hits = [F.when(matches(text, regex), F.lit(topic)) for topic, _, regex in topics]
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def is_product_release(
    title: Column, desc: Column, shipping: str = V.RELEASE_SHIPPING, question: str = V.QUESTION_HEADLINE
) -> Column:
    """Shipping language, and not a headline that asks."""
    return ~matches(title, question) & matches(headline_text(title, desc), shipping)


def is_release_discussion(text: Column, regex: str = V.RELEASE_TALK) -> Column:
    return matches(text, regex)


def mention_confidence(text: Column, matcher: dict, context: str = V.AI_CONTEXT) -> Column:
    """How surely a text is about one model family, 0 to 1."""

    def seen(name: str) -> Column:
        return matches(text, matcher[name]) if matcher.get(name) else F.lit(False)

    strong = F.lit(False)
    for regex in matcher["strong"]:
        strong = strong | matches(text, regex)
    base = seen("base") if matcher.get("base") else strong
    in_context = matches(text, context)
    if matcher.get("ambiguous"):
        plain = base & ~seen("reject") & (in_context | seen("org"))
        return F.when(strong, F.lit(0.9)).when(plain, F.lit(0.6)).otherwise(F.lit(0.0))
    total = F.lit(0.55)
    for condition, gain in [
        (seen("org"), 0.15), (seen("version"), 0.15), (seen("product"), 0.1), (in_context, 0.05),
    ]:
        total = total + F.when(condition, F.lit(gain)).otherwise(F.lit(0.0))
    return F.when(strong | base, F.least(total, F.lit(1.0))).otherwise(F.lit(0.0))


def match_models(
    df: DataFrame, text: str, matchers: dict = V.MODEL_MATCHERS, context: str = V.AI_CONTEXT,
    threshold: float = V.MATCH_THRESHOLD,
) -> DataFrame:
    """One row per text and model it is validly about: adds ``model``, ``match_confidence``.

    All matchers run in one pass; only validated pairs leave the row.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(key).alias("model"),
                mention_confidence(F.col(text), m, context).alias("match_confidence"),
            )
            for key, m in matchers.items()
        ]
    )
    valid = F.filter(found, lambda m: m["match_confidence"] >= threshold)
    return df.select("*", F.inline(valid))


def salient_objects(title: Column, desc: Column, strong: str = V.STRONG_OBJECTS, weak: str = V.WEAK_OBJECTS) -> Column:
    text = headline_text(title, desc)
    return F.array_union(F.array_union(name_phrases(title), find_nouns(text, strong)), find_nouns(text, weak))


def distinctive_objects(title: Column, desc: Column, strong: str = V.STRONG_OBJECTS) -> Column:
    return F.array_union(name_phrases(title), find_nouns(headline_text(title, desc), strong))


def classify_verification(
    title: Column, desc: Column, category: Column, source_count: Column, official: Column,
    hedging: str = V.HEDGING,
) -> Column:
    """``official`` says whether any merged source is the subject's own channel."""
    return (
        F.when(category == "analysis", F.lit("analysis"))
        .when(F.coalesce(official, F.lit(False)), F.lit("official"))
        .when(matches(headline_text(title, desc), hedging), F.lit("uncertain"))
        .when(F.coalesce(source_count, F.lit(1)) >= 2, F.lit("corroborated"))
        .otherwise(F.lit("single"))
    )


def classify_impact(significance: Column) -> Column:
    return (
        F.when(significance >= V.HIGH_IMPACT, F.lit("high"))
        .when(significance >= V.NOTABLE_IMPACT, F.lit("notable"))
        .otherwise(F.lit("emerging"))
    )


def apply_integrity_caps(
    df: DataFrame, cap: int = V.GENERAL_SIGNIFICANCE_CAP, job: str = V.JOB_POSTING, speculative: str = V.SPECULATIVE
) -> DataFrame:
    """Cap weakly sourced commentary; adds ``impact``, ``capped``, ``cap_reason``."""
    text, lower = F.col("_text"), F.col("_lower")
    strong = (F.col("verification") == "official") | (F.coalesce(F.col("source_count"), F.lit(1)) >= 2)
    weak_general = F.col("category").isin(V.COMMENTARY_CATEGORIES) & ~F.coalesce(strong, F.lit(False))
    over = weak_general & (F.col("significance") > cap)
    capped = add_once(
        with_headline(df),
        {
            "_general": weak_general,
            "_over": over,
            "_soft": matches(text, job, lower=lower) | matches(text, speculative, lower=lower),
            "significance": F.when(over, F.lit(cap)).otherwise(F.col("significance")).cast("int"),
        },
    ).drop("_text", "_lower").withColumn("_raw", classify_impact(F.col("significance")))
    high = F.col("_raw") == "high"
    reason = (
        F.when(F.col("_over"), F.lit("single-source-general"))
        .when(F.col("_general") & high, F.lit("general-without-evidence"))
        .when(F.col("_soft") & high, F.lit("job-or-speculative"))
    )
    lowered = high & (F.col("_general") | F.col("_soft"))
    return capped.withColumns(
        {
            "impact": F.when(lowered, F.lit("notable")).otherwise(F.col("_raw")),
            "cap_reason": reason,
            "capped": reason.isNotNull(),
        }
    ).drop("_general", "_over", "_soft", "_raw")


def why_it_matters(
    df: DataFrame,
    by_action: dict = V.CONSEQUENCE_BY_ACTION,
    by_category: dict = V.CONSEQUENCE_BY_CATEGORY,
    conditional: str = V.CONDITIONAL_WORDING,
    prefix: str = V.WEAK_PREFIX,
    actions=V.ACTION_RULES,
    name: str = "why_it_matters",
) -> DataFrame:
    """Add the consequence sentence; weak reports get the hedged prefix."""

    def sentences(table: dict) -> Column:
        # whether a sentence is already conditional is known when planning
        import re

        rows = []
        for key, text in table.items():
            held = text if re.search(conditional, text, re.I) else prefix + text[0].lower() + text[1:]
            rows += [F.lit(key), F.struct(F.lit(text).alias("plain"), F.lit(held).alias("hedged"))]
        return F.create_map(*rows)

    action = extract_action(headline_text(F.col("title"), F.col("desc")), actions)
    chosen = F.coalesce(
        F.try_element_at(sentences(by_action), F.coalesce(action, F.lit(""))),
        F.try_element_at(sentences(by_category), F.coalesce(F.col("category"), F.lit(""))),
        F.try_element_at(sentences(by_category), F.lit(V.FALLBACK_CATEGORY)),
    )
    weak = F.coalesce(F.col("impact") == "emerging", F.lit(False)) | F.coalesce(
        F.col("verification").isin("single", "uncertain"), F.lit(False)
    )
    return (
        df.withColumn("_chosen", chosen)
        .withColumn(name, F.when(weak, F.col("_chosen.hedged")).otherwise(F.col("_chosen.plain")))
        .drop("_chosen")
    )


def contains_pattern(text: Column, regex: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern(regex))
