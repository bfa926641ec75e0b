"""String functions as Column expressions (all JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom import fixed_values as V

# Word boundary over ASCII word characters; Java's own treats accented letters
# as part of a word.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_SPACES = r"\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACE = f"[{_SPACES}]"


def _branches(rest: str) -> tuple[list[str], str]:
    """Alternatives of the group ``rest`` opens with, and what follows the group."""
    depth, branch, branches = 0, "", []
    for k, c in enumerate(rest):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return [b.removeprefix("?:") for b in [*branches, branch]], rest[k + 1 :]
        if c == "|" and depth == 1:
            branches.append(branch)
            branch = ""
        elif k:
            branch += c
    return [], ""


def _starts_with_word(rest: str) -> bool:
    """Whether everything ``rest`` can match begins with a word character."""
    if rest[:2] in (r"\w", r"\d"):
        return rest[2:3] not in ("?", "*")
    if rest[:1].isalnum():
        return rest[1:2] not in ("?", "*")
    if not rest.startswith("("):
        return False
    branches, after = _branches(rest)
    return after[:1] not in ("?", "*") and all(map(_starts_with_word, branches))


def _leading_words(regex: str) -> list[str] | None:
    """Lower-case literals one of which starts every match, if that can be told."""
    regex = regex.removeprefix(r"\b")
    if regex.startswith("("):
        branches, after = _branches(regex)
        parts = [_leading_words(b) for b in branches]
        if after[:1] in ("?", "*") or "|" in after or not parts or None in parts:
            return None
        return [w for p in parts for w in p]
    if "|" in regex and "(" not in regex:
        parts = [_leading_words(b) for b in regex.split("|")]
        return None if None in parts else [w for p in parts for w in p]
    if re.search(r"\|(?![^(]*\))", regex):
        return None  # an alternative outside any group
    word = re.match(r"[A-Za-z0-9 ]*", regex).group(0)
    if regex[len(word) : len(word) + 1] in ("?", "*", "{"):
        word = word[:-1]
    return [word.lower()] if len(word) > 1 else None


def pattern(regex: str, ignore_case: bool = True) -> str:
    """Java form of a pattern from :mod:`fixed_values`.

    A boundary before a word character is a plain look-behind, which Java checks
    several times faster than the general form.
    """
    head, *parts = regex.split(r"\b")
    java = head
    for part in parts:
        java += (r"(?<!\w)" if _starts_with_word(part) else _EDGE) + part
    java = java.replace(r"\s", SPACE)
    return ("(?i)" if ignore_case else "") + java


def matches(text: Column, regex: str, ignore_case: bool = True, lower: Column | None = None) -> Column:
    """Whether the pattern occurs.  A plain substring search goes first where the
    pattern has to start with one of a few words; it is many times cheaper.
    ``lower`` is the text in lower case, where a caller has it already (see :func:`with_headline`)."""
    text = F.coalesce(text, F.lit(""))
    found = text.rlike(pattern(regex, ignore_case))
    words = _leading_words(regex) if ignore_case else None
    if not words or len(set(words)) > 12:
        return found
    lower = F.lower(text) if lower is None else lower
    possible = F.contains(lower, F.lit(words[0]))
    for word in sorted(set(words[1:])):
        possible = possible | F.contains(lower, F.lit(word))
    return possible & found


def headline_text(title: Column, desc: Column) -> Column:
    """Title and description as one text; a missing description is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(desc, F.lit("")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that later filters and projections must not repeat.

    A plain ``withColumn`` is inlined into every filter pushed below it; columns
    that come out of a generator are computed once per row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_headline(df: DataFrame, title: str = "title", desc: str = "desc") -> DataFrame:
    """Add ``_text``, title and description as one, and ``_lower``: made once per row, for any number of patterns."""
    text = headline_text(F.col(title), F.col(desc))
    return add_once(add_once(df, {"_text": text}), {"_lower": F.lower(F.col("_text"))})


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def _without_apostrophes(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.replace(F.replace(lower, F.lit("'"), F.lit("")), F.lit("’"), F.lit(""))


def normalize_title(text: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(_without_apostrophes(text), "[^a-z0-9]+", " "))


def plain_words(text: Column, min_length: int = 1) -> Column:
    """The words of :func:`normalize_title` in order, those of at least ``min_length`` letters; cut in one pass over the text."""
    return F.filter(F.split(_without_apostrophes(text), "[^a-z0-9]+"), lambda w: F.length(w) >= max(min_length, 1))


def token_set(text: Column, stop_words=V.STOP_WORDS, min_length: int = V.MIN_TOKEN_LENGTH) -> Column:
    """Distinct significant tokens in order of appearance."""
    words = plain_words(text, min_length)
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words]))


def _code_point(number: Column) -> Column:
    as_hex = F.lpad(F.hex(number), 8, "0")
    valid = (number >= 1) & (number <= 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(as_hex), "UTF-32"))


def _expand_references(text: Column, regex: str, base: int) -> Column:
    """Replace numeric character references found by ``regex`` in one pass."""
    def rebuilt(piece: Column, ref: Column) -> Column:
        digits = F.ltrim(ref, F.lit("0"))
        number = F.conv(F.when(F.length(digits) <= 8, digits), base, 10).cast("bigint")
        original = F.concat(F.lit("&#x" if base == 16 else "&#"), ref, F.lit(";"))
        return F.concat(piece, F.coalesce(_code_point(number), original, F.lit("")))

    def expanded(t: Column) -> Column:
        pieces = F.split(t, regex.replace("(", "(?:"))
        refs = F.regexp_extract_all(t, F.lit(regex), F.lit(1))
        joined = F.array_join(F.zip_with(pieces, refs, rebuilt), "")
        return F.when(t.rlike(regex), joined).otherwise(t)

    return let(text, expanded)


def decode_entities(text: Column) -> Column:
    """Unwrap CDATA, decode references, then strip tags and squeeze spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")
    out = _expand_references(out, "&#x([0-9a-fA-F]+);", 16)
    out = _expand_references(out, "&#([0-9]+);", 10)
    for entity, char in V.NAMED_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "<[^>]+>", "")
    return F.trim(F.regexp_replace(out, f"{SPACE}+", " "))


def truncate(text: Column, n: int) -> Column:
    """Cut to ``n`` characters, the last one an ellipsis."""
    cut = F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))
    return F.when(F.length(text) > n, cut).otherwise(F.coalesce(text, F.lit("")))


def excerpt(html: Column, limit: int = 180, focus: Column | str = "") -> Column:
    """A clean excerpt of at most ``limit`` characters around ``focus``."""
    focus = F.lit(focus) if isinstance(focus, str) else focus

    def cut(text: Column) -> Column:
        at = F.when(F.length(focus) > 0, F.instr(F.lower(text), F.lower(focus)) - 1).otherwise(F.lit(-1))
        start = F.when(at > limit * 0.5, at - int(limit * 0.35)).otherwise(F.lit(0))
        return F.when(F.length(text) <= limit, text).otherwise(let(start, lambda s: shortened(text, s)))

    def shortened(text: Column, start: Column) -> Column:
        gap = F.instr(text.substr(start + 1, F.lit(limit)), " ") - 1
        skip = F.when((start > 0) & (gap > 0) & (gap < 25), gap + 1).otherwise(F.lit(0))
        head = let(skip, lambda k: text.substr(start + 1 + k, F.lit(limit) - k))
        lead = F.when(start > 0, F.lit("…")).otherwise(F.lit(""))
        return F.concat(lead, F.rtrim(let(head, to_last_gap)), F.lit("…"))

    def to_last_gap(head: Column) -> Column:
        last_gap = F.length(head) - F.instr(F.reverse(head), " ")
        whole_words = (F.instr(head, " ") > 0) & (last_gap > limit * 0.6)
        return F.when(whole_words, head.substr(F.lit(1), last_gap)).otherwise(head)

    return let(decode_entities(html), cut)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != ""))


def is_quote_only(text: Column) -> Column:
    """Every non-blank line is a quoted reply."""
    return F.forall(
        F.split(text, "\n"), lambda line: (trim_all(line) == "") | trim_all(line).startswith(">")
    )


def html_escape(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


# ``V.NAME_PHRASE`` for Java, whose groups recurse once a repetition unless they are possessive: a phrase of some thousand
# words would overflow the stack.  ``_MORE`` takes words that the phrase may end in and that white space follows, with the
# initials ("J.") before them, which it cannot end in; ``_LAST`` the word after them, as far as a boundary.
_INITIALS = rf"\.*+{SPACE}++(?:[A-Z]\.++{SPACE}++)*+"
_MORE = rf"(?:{_INITIALS}[A-Z](?:\.*+[a-zA-Z]++)++(?=\.*+{SPACE}))"
_LAST = rf"{_INITIALS}[A-Z][a-zA-Z.]+{_EDGE}"
_PHRASE = rf"(?<!\w)[A-Z](?=[a-zA-Z.])(?:\.*+[a-zA-Z]++)*+(?:{_MORE}++(?:{_LAST})?|{_LAST})"


def name_phrases(title: Column) -> Column:
    """Distinct capitalised multi-word phrases (``V.NAME_PHRASE``), lower-cased."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(_PHRASE), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def find_nouns(text: Column, regex: str, spellings: dict[str, str] = V.OBJECT_SPELLINGS) -> Column:
    """Distinct nouns matching ``regex`` under one spelling each."""

    def unify(noun: Column) -> Column:
        out = F.lower(noun)
        for variant, name in spellings.items():
            out = F.when(out == variant, F.lit(name)).otherwise(out)
        return out

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(regex)), F.lit(0))
    return F.array_distinct(F.transform(found, unify))


def stable_id(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, in base 36."""
    units = F.transform(
        F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1)),
        lambda u: F.conv(u, 16, 10).cast("bigint"),
    )
    digest = F.aggregate(
        units,
        F.lit(0x811C9DC5).cast("bigint"),
        lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return F.lower(F.conv(digest.cast("string"), 10, 36))


def literal_term_pattern(term: str) -> str:
    """Boundary-anchored pattern of one entity term.

    Terms with their own boundary marks stay as they are; terms with digit
    classes or brackets are fragments; all others are plain words.
    """
    if r"\b" in term:
        return term
    fragment = r"\d" in term or "[" in term or "]" in term
    return rf"\b{term if fragment else re.sub(r'([.*+?^${}()|\[\]\\])', r'\\\1', term)}\b"
