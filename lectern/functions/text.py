"""String scalars. Character classes are spelled out, since engines differ in what ``\\s`` and ``\\w`` mean."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, Unicode included.
WS = r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize_text(c: Column) -> Column:
    """Null to empty; no-break spaces to spaces; blanks collapse; line ends lose the white space around them; trimmed."""
    c = F.translate(F.coalesce(c, F.lit("")), "\u00a0", " ")
    c = F.regexp_replace(c, r"[ \t\r\f\x0b]+", " ")
    return strip(F.regexp_replace(c, f"{WS}*\n{WS}*", "\n"))


def safe_text(c: Column) -> Column:
    return normalize_text(c.cast("string"))


def collapse(c: Column) -> Column:
    """All white space runs to one space, trimmed."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def strip_html_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def match_key(c: Column) -> Column:
    """Canonical key for comparing texts: lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(normalize_text(c)), r"[^\p{L}\p{N}]+", "")


def overlap_key(c: Column) -> Column:
    return F.lower(collapse(normalize_text(c)))


def heading_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(normalize_text(c)), r"[.: ]+$", "")


def title_key(c: Column) -> Column:
    """Lower case with runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def journal_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(normalize_text(c)), "&", " and ")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def author_name(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def author_key(c: Column) -> Column:
    """``Last, First`` and ``First Last`` get the same key."""
    parts = F.filter(F.transform(F.split(author_name(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    turned = F.when(F.size(parts) >= 2, F.concat_ws(" ", F.concat(F.slice(parts, 2, F.size(parts) - 1), F.slice(parts, 1, 1)))).otherwise(author_name(c))
    return F.trim(F.regexp_replace(F.lower(turned), "[^a-z0-9]+", " "))


def abstract_text(c: Column) -> Column:
    """The text without a leading ``Abstract`` or ``Summary`` label, plain or bold."""
    return F.ltrim(F.regexp_replace(normalize_text(c), r"^(?i)(\*\*)?(abstract|summary)[.:]?(\*\*)?[.: \n]+", ""))


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), collapse), lambda x: x != "")


def sup_sub_bodies(c: Column) -> Column:
    """White space just inside <sup> and <sub> goes."""
    return F.regexp_replace(F.regexp_replace(c, r"<(sup|sub)>[ \t\n]+", "<$1>"), r"[ \t\n]+</(sup|sub)>", "</$1>")


def table_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def word_count(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.size(F.regexp_extract_all(c, F.lit(f"({WORD})"))).cast("long")


def space_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"{WS}+"), lambda x: x != "")).cast("long")


def sentence_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"([.!?]+(?:{WS}|$))"))).cast("long")


def cjk_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}])"))).cast("long")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for an empty text."""
    return F.ceil(F.length(c) / 4).cast("long")


def truncate_to_tokens(c: Column, budget: int) -> Column:
    """The text if it fits, else its head of 4 characters a token (32 at least) without trailing marks, and an ellipsis."""
    if budget <= 0:
        return F.lit("")
    head = F.regexp_replace(F.left(c, F.lit(max(32, 4 * budget))), "[ ,;:\n]+$", "")
    return F.when(token_estimate(c) <= budget, c).otherwise(F.when(F.length(head) < F.length(c), F.concat(head, F.lit("..."))).otherwise(head))


def safe_filename(c: Column, longest: int = 180) -> Column:
    """Letters, digits, dot, dash and underscore; a long or empty name ends in part of a hash of the original."""
    c = F.coalesce(c, F.lit(""))
    digest = F.left(F.sha1(c.cast("binary")), F.lit(8))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "_+", "_"), "^[._-]+|[._-]+$", "")
    cut = F.regexp_replace(F.left(F.regexp_replace(F.left(name, F.lit(longest)), "[._-]+$", ""), F.lit(longest - 9)), "[._-]+$", "")
    cut = F.when(cut == "", "fulltext").otherwise(cut)
    return F.when(name == "", F.concat(F.lit("fulltext_"), digest)).when(F.length(name) <= longest, name).otherwise(F.concat(cut, F.lit("_"), digest))


def display_name(c: Column) -> Column:
    c = F.replace(F.replace(F.lower(normalize_text(c)), F.lit("-"), F.lit("_")), F.lit("_"), F.lit(" "))
    return F.when(c == "", "Provider").otherwise(F.initcap(c))


def snippet(c: Column, limit: int) -> Column:
    return F.left(collapse(c), F.lit(limit))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def ordered_distinct(c: Column) -> Column:
    """Normalised, non-empty strings of an array, each at its first place."""
    return F.array_distinct(F.filter(F.transform(c, normalize_text), lambda x: x != ""))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def contains_any(c: Column, tokens: Sequence[str]) -> Column:
    """One pass of a pattern over the text, rather than one per token."""
    return c.rlike("|".join(re.escape(t) for t in tokens))


def starts_any(c: Column, tokens: Sequence[str]) -> Column:
    return c.rlike(f"^(?:{'|'.join(re.escape(t) for t in tokens)})")


def tokens_found(c: Column, tokens: Sequence[str]) -> Column:
    """Those of the tokens that occur, in their own order."""
    return F.filter(F.array(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in tokens]), lambda x: x.isNotNull())
