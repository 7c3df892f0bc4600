"""Scalars over headings, links, labels and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import author_key, author_name, contains_any, let, match_key, normalize_text

# Titles that name no article.
USELESS_TITLES = ("redirecting", "sign in", "just a moment", "cookie", "subscribe", "access denied")
# Names of reference anchors.
REFERENCE_NAMES = ("ref", "refs", "reference", "bib", "bibr", "bibliography", "cite", "citation", "cr")
# Parts of addresses of full-size images and of previews.
FULL_SIZE = ("/full/", "/large/", "/original/", "/fullsize/", "download=true", "download=1", "hi-res", "hires", "high-res", "highres")
PREVIEW = ("/thumb/", "/thumbnail/", "thumbnail", "/small/", "/preview/")
# Texts and file suffixes of links to supplementary material.
SUPPLEMENT_TEXTS = ("supplementary", "supplemental", "supporting information", "supporting material")
SUPPLEMENT_SUFFIXES = (".pdf", ".csv", ".xlsx", ".xls", ".zip", ".txt", ".json", ".xml", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".tif", ".tiff")
# Serial numbers of journals whose code is part of their DOIs.
JOURNAL_CODES = {"1424-8220": "s", "1660-4601": "ijerph", "1996-1073": "en", "2071-1050": "su", "2072-4292": "rs", "2073-4441": "w", "2077-0375": "membranes", "2227-7390": "math", "2304-8158": "foods"}
_LABEL = r"([A-Za-z]?[0-9]+[A-Za-z]?(?:\.[0-9]+[A-Za-z]?)*)"


def without_title(markdown: Column, title: Column) -> Column:
    """Markdown without its first line and the blank lines behind it, where that line is a first-level heading equal to the title."""
    first = F.regexp_extract(markdown, r"^[ \n]*#[ \t]*([^#\n][^\n]*)", 1)
    same = (normalize_text(title) != "") & (first != "") & (match_key(first) == match_key(title))
    return F.when(same, F.regexp_replace(markdown, r"^[ \n]*#[^\n]*\n*", "")).otherwise(markdown)


def joined_lines(text: Column) -> Column:
    """Prose with one line for each paragraph; paragraphs are parted by blank lines."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)+"), lambda p: normalize_text(F.regexp_replace(p, r"[ \t]*\n[ \t]*", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def plain_lines(text: Column) -> Column:
    """Lines without blanks at their ends, of several empty ones in a row one; one line end at the end."""
    ends = F.regexp_replace(F.regexp_replace(text, r"[ \t]+(\n|$)", "$1"), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(ends, r"^[ \t\n]+|[ \t\n]+$", ""), F.lit("\n"))


def caption_key(text: Column) -> Column:
    """Key under which captions are compared: without images, sub and sup marks and decoration."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")
    return match_key(F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(?:sub|sup)>", ""), r"[*_`$]+", ""))


def chemistry(text: Column) -> Column:
    """Digits and signs in one-character sub and sup elements as Unicode; runs are handled sign by sign."""
    low, high = "₀₁₂₃₄₅₆₇₈₉₊₋", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻"

    def turned(c: Column, tag: str, signs: str) -> Column:
        parts = F.split(c, rf"(?i)(?=<{tag}>[^<]*</{tag}>)")
        inner = lambda p: F.regexp_extract(p, rf"(?i)^<{tag}>([^<]*)</{tag}>", 1)
        held = lambda p: p.rlike(rf"(?i)^<{tag}>[^<]*</{tag}>")
        return F.array_join(F.transform(parts, lambda p: F.when(held(p), F.concat(F.translate(inner(p), "0123456789+-", signs), F.regexp_replace(p, rf"(?i)^<{tag}>[^<]*</{tag}>", ""))).otherwise(p)), "")

    return turned(turned(text, "sub", low), "sup", high)


def image_alt(kind: Column, heading: Column, fallback: Column) -> Column:
    """Short label of an image from its kind and the number in its heading."""

    def number(name: str) -> Column:
        found = [F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)\b{name}\s*\.?\s*{_LABEL}", 1) for c in (heading, fallback)]
        return F.coalesce(*[F.when(f != "", f) for f in found])

    numbered = lambda label, name: F.concat(F.lit(f"{label} "), number(name))
    k = F.lower(normalize_text(kind))
    figure = F.coalesce(numbered("Figure", "fig(?:ure)?"), numbered("Listing", "listing"), F.lit("Figure"))
    return F.when(k == "figure", figure).when(k == "listing", F.coalesce(numbered("Listing", "listing"), F.lit("Listing"))).when(k == "table", F.coalesce(numbered("Table", "table"), F.lit("Table"))).when(k.isin("formula", "equation"), "Formula").otherwise("Image")


def refresh_target(content: Column) -> Column:
    """Address in the content of a refresh element; null where there is none."""
    found = F.regexp_extract(F.coalesce(content, F.lit("")), r"""(?i)url\s*=\s*['"]?([^'";>]+)""", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def is_reference_href(href: Column) -> Column:
    """Whether the fragment of a link names a reference."""
    names = "|".join(REFERENCE_NAMES)
    fragment = F.regexp_extract(normalize_text(href), r"#(.*)$", 1)
    named = rf"(?i)(?:^|[-_/])(?:{names})\b|^core-collateral-r[0-9]+[a-z0-9-]*$|^(?:r|ref|bibr|bib|cr)[0-9]+[a-z0-9-]*$"
    return F.coalesce(fragment.rlike(named), F.lit(False))


def usable_title(title: Column, least: int = 0) -> Column:
    return let(F.lower(normalize_text(title)), lambda t: (t != "") & (F.length(t) >= least) & ~contains_any(t, USELESS_TITLES))


def distinct_authors(names: Column) -> Column:
    """Names in order, each key once; the first spelling stays."""
    rows = F.filter(F.transform(names, lambda n: F.struct(author_key(author_name(n)).alias("k"), author_name(n).alias("n"))), lambda r: r["k"] != "")
    firsts = F.transform(F.array_distinct(F.transform(rows, lambda r: r["k"])), lambda k: F.get(F.filter(rows, lambda r: r["k"] == k), F.lit(0))["n"])
    return firsts


def count_or_null(value: Column) -> Column:
    """A whole number of 0 or more; null for anything else."""
    return let(F.try_to_number(F.when(F.trim(value).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(value)), F.lit("S999999999999999999")).cast("long"), lambda n: F.when(n >= 0, n))


def is_supplement(href: Column, text: Column) -> Column:
    h = F.lower(normalize_text(href))
    return (h != "") & ~F.startswith(h, F.lit("#")) & (contains_any(F.lower(normalize_text(text)), SUPPLEMENT_TEXTS) | contains_any(h, SUPPLEMENT_SUFFIXES))


def is_full_size(url: Column) -> Column:
    return let(F.lower(normalize_text(url)), lambda u: (u != "") & ~contains_any(u, PREVIEW) & contains_any(u, FULL_SIZE))


def mixes_reference_lists(markdown: Column) -> Column:
    """Whether a references section has numbered and bulleted items."""
    block = F.regexp_extract(F.concat(F.lit("\n"), markdown), r"(?is)\n[ ]{0,3}#{1,6}[ \t]+references(?:[ \t(][^\n]*)?(?=\n)(.*?)(?=\n[ ]{0,3}#{1,6}[ \t]|\z)", 1)
    return block.rlike(r"\n[ \t]*(?:[0-9]{1,4}[.)]|\[[0-9]{1,4}\])[ \t]+[^ \t\n]") & block.rlike(r"\n[ \t]*[-*+][ \t]+[^ \t\n]")


def journal_doi(url: Column) -> Column:
    """DOI that a numeric article address stands for: code of the journal, volume, issue and article padded with zeros."""
    part = lambda k: F.regexp_extract(url, r"^https?://(?:www\.)?mdpi\.com/([0-9]{4}-[0-9]{3}[0-9Xx])/([0-9]+)/([0-9]+)/([0-9]+)", k)
    codes = F.create_map(*[F.lit(x) for pair in JOURNAL_CODES.items() for x in pair])
    wide = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))
    return F.when(part(1) != "", F.concat(F.lit("10.3390/"), F.try_element_at(codes, F.lower(part(1))), part(2), wide(part(3), 2), wide(part(4), 4)))


def first_item(values: Column) -> Column:
    return F.get(values, F.lit(0))


def is_subset(some: Column, of: Column) -> Column:
    return F.size(F.array_except(some, of)) == 0
