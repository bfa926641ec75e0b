"""Queries by name, each with the equivalent SQL where SQL can say it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---- pieces of SQL text -----------------------------------------------------
SPACES = r"\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
ITEMS = """items AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS descr,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((doc_id * 7919) % 720 AS BIGINT)) AS published_at,
    'doc/' || doc_id AS link, source AS source_name,
    split_part(text, chr(10), 1) || ' ' || text AS btxt
  FROM documents)"""
COMMENTS = """comments AS (
  SELECT conv_id * 1000 + turn AS comment_id, conv_id, turn, role, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(((conv_id * 1000 + turn) * 7919) % 720 AS BIGINT)) AS published_at
  FROM conversations)"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(regex: str, ignore_case: bool = True) -> str:
    return lit(("(?i)" if ignore_case else "") + regex.replace(r"\s", f"[{SPACES}]"))


def has(expr: str, regex: str) -> str:
    return f"regexp_matches({expr}, {re2(regex)})"


def first_match(expr: str, rules, default: str = "NULL") -> str:
    cases = " ".join(f"WHEN {has(expr, r)} THEN {lit(name)}" for name, r in rules)
    return f"CASE {cases} ELSE {default} END"


def tokens(expr: str) -> str:
    from signalloom.fixed_values import STOP_WORDS

    clean = f"trim(regexp_replace(regexp_replace(lower({expr}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    stop = "[" + ", ".join(lit(w) for w in STOP_WORDS) + "]"
    return (
        f"list_distinct(list_filter(string_split({clean}, ' '), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({stop}, w)))"
    )


def phrases(expr: str) -> str:
    from signalloom.fixed_values import NAME_PHRASE

    return f"list_distinct(list_transform(regexp_extract_all({expr}, {re2(NAME_PHRASE, False)}), lambda p: lower(p)))"


def nouns(expr: str, regex: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({expr}, {re2(regex)}), lambda p: lower(p)))"


def half_up(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * {10 ** digits}.0 + 0.5) / {10 ** digits}.0)"


def clamp01(expr: str) -> str:
    return f"greatest(0.0, least(1.0, {expr}))"
