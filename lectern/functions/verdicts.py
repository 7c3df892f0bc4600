"""Signals, categories, verdicts and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import contains_any, heading_key, let, normalize_text, starts_any, tokens_found

# Phrases that pages show instead of an article, and the reasons they stand for.
CHALLENGE_PHRASES = (
    "just a moment", "verify you are human", "checking your browser", "challenge-error-text", "attention required",
    "cloudflare", "radware bot manager", "perfdrive", "confirm you are a human", "h-captcha",
)
NOT_FOUND_PHRASES = ("doi not found", "page not found", "article not found", "content not found")
GATE_PHRASES = (
    "check access", "purchase access", "purchase digital access to this article", "institutional access", "login to your account",
    "log in to your account", "subscribe to continue", "access through your institution", "rent or buy", "purchase this article",
    "purchase article", "access the full article", "get full access to this article", "get access", "access this article",
    "buy article pdf", "buy now", "sign in to access", "view access options",
    "view all access options to continue reading this article", "institutional login",
    "this is a preview of subscription content",
)

# Headings by category.
ABSTRACT_HEADINGS = ("abstract", "structured abstract", "editor's summary", "editor’s summary", "editors summary", "summary", "significance", "significance statement", "resumo", "resumen", "resume", "résumé", "zusammenfassung")
DATA_HEADINGS = ("data availability", "data availability statement", "data, materials, and software availability", "data, code, and materials availability", "availability of data and materials")
CODE_HEADINGS = ("code availability", "code availability statement", "software availability", "software availability statement")
BACK_HEADINGS = (
    "references", "references and notes", "bibliography", "electronic supplementary material", "supplementary material", "supplementary materials",
    "supplementary information", "supporting information", "notes", "acknowledgements", "acknowledgments", "author contributions", "funding",
    "research funding", "ethics", "conflict of interest", "conflicts of interest", "competing interests", "statement of competing interests",
    "disclosures",
)
SIDE_HEADINGS = (
    "recommended", "related content", "related articles", "metrics", "metrics & citations", "view options", "authors", "affiliations", "author information",
    "information & authors", "information and authors", "citations", "submission history", "license information", "cite as", "export citation",
    "cited by", "citing literature", "figures", "tables", "media", "share", "permissions", "eletters", "corresponding author",
    "additional information", "rights and permissions", "profiles", "subscribe and save", "publisher's note", "publisher’s note", "open access",
)
FRONT_HEADINGS = ("keywords", "key points", "about this article", "author notes", "authors", "article information", "highlights", "graphical abstract")

# Order in which sections are worth their tokens; a heading that holds a key counts like it, 4 otherwise.
SECTION_PRIORITY = {
    "significance": -1, "significance statement": -1, "abstract": 0, "introduction": 1, "background": 1, "methods": 2, "materials and methods": 2,
    "methodology": 2, "results": 3, "findings": 3, "discussion": 4, "conclusion": 5, "conclusions": 5, "abbreviations": 6, "data availability": 6,
    "data availability statement": 6, "data, materials, and software availability": 6, "data, code, and materials availability": 6,
    "availability of data and materials": 6, "code availability": 6, "code availability statement": 6, "software availability": 6,
    "software availability statement": 6, "references": 6,
}

# What counts as enough text.
SHORT_BODY_CHARS, SHORT_BODY_WORDS, SINGLE_BLOCK_WORDS = 300, 60, 90
CJK_CHARS, CJK_SINGLE_BLOCK, CJK_RATIO, BODY_TO_ABSTRACT = 120, 180, 0.20, 1.5


def access_signals(title: Column, text: Column, status: Column, redirected: Column | None = None, no_access: Column | None = None, paywall_text: bool = True) -> Column:
    """Signals against full text, the decisive one first."""
    never = F.lit(False)

    def found(both: Column) -> Column:
        challenge = contains_any(both, CHALLENGE_PHRASES)
        denied = (F.coalesce(status.isin(401, 402, 403), never) & ~challenge) | (never if no_access is None else no_access)
        pairs = [
            (never if redirected is None else redirected, "redirected_to_abstract"),
            (challenge, "cloudflare_challenge"),
            (F.coalesce(status == 404, never) | contains_any(both, NOT_FOUND_PHRASES), "publisher_not_found"),
            (denied, "publisher_access_denied"),
            (contains_any(both, GATE_PHRASES) if paywall_text else never, "publisher_paywall"),
        ]
        return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]), lambda x: x.isNotNull())

    return let(F.lower(normalize_text(F.concat_ws(" ", title, text))), found)


def gate_phrases(text: Column) -> Column:
    return tokens_found(F.lower(normalize_text(text)), GATE_PHRASES)


def heading_category(tag: Column, text: Column, title: Column | None = None) -> Column:
    front = F.lower(F.trim(tag)) == "h1"
    named = F.lit(None).cast("string") if title is None else heading_key(title)
    return let(
        heading_key(text),
        lambda key: F.when(front, "front_matter")
        .when(key == "", "body_heading")
        .when(F.coalesce(key == named, F.lit(False)), "front_matter")
        .when(contains_any(key, GATE_PHRASES), "ancillary")
        .when(key.isin(*ABSTRACT_HEADINGS) | F.startswith(key, F.lit("abstract")), "abstract")
        .when(starts_any(key, DATA_HEADINGS), "data_availability")
        .when(starts_any(key, CODE_HEADINGS), "code_availability")
        .when(starts_any(key, BACK_HEADINGS), "references_or_back_matter")
        .when(starts_any(key, SIDE_HEADINGS), "ancillary")
        .when(key.isin(*FRONT_HEADINGS), "front_matter")
        .otherwise("body_heading"),
    )


def section_kind(heading: Column) -> Column:
    kinds = {"data_availability": "data_availability", "code_availability": "code_availability", "references_or_back_matter": "references", "abstract": "abstract", "ancillary": "diagnostics"}
    of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return let(
        F.lower(normalize_text(heading)),
        lambda key: F.when(key == "", "body")
        .when(key.isin("references", "bibliography"), "references")
        .when(key.isin("supplementary materials", "supplementary information"), "supplementary")
        .when(key == "conversion notes", "diagnostics")
        .otherwise(F.coalesce(F.try_element_at(of, heading_category(F.lit("h2"), key)), F.lit("body"))),
    )


def section_priority(heading: Column) -> Column:
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in SECTION_PRIORITY.items()])
    return let(
        F.lower(normalize_text(heading)),
        lambda key: F.coalesce(F.get(F.filter(names, lambda x: x["k"] == key), F.lit(0))["p"], F.get(F.filter(names, lambda x: F.contains(key, x["k"])), F.lit(0))["p"], F.lit(4)),
    )


def sufficient_body(chars: Column, words: Column, blocks: Column, headings: Column, cjk: Column, has_abstract: Column, ratio: Column) -> Column:
    """Whether a body is long enough, with a path of its own for Chinese, Japanese and Korean text."""
    structure = (blocks >= 2) | (headings >= 1)
    single = (blocks == 1) & (~has_abstract | (ratio >= BODY_TO_ABSTRACT))
    share = F.when(chars > 0, cjk / chars).otherwise(0.0)
    is_cjk = (cjk >= CJK_CHARS) & (share >= CJK_RATIO)
    as_cjk = structure | (single & (cjk >= CJK_SINGLE_BLOCK))
    plain = (words >= SHORT_BODY_WORDS) & (structure | (single & (words >= SINGLE_BLOCK_WORDS)))
    return (chars >= SHORT_BODY_CHARS) & F.when(is_cjk, as_cjk).otherwise(plain)


def accepts_structure(explicit: Column, paragraphs: Column, post_abstract: Column, run: Column, run_chars: Column, narrative: Column) -> Column:
    return (explicit & (paragraphs >= 1)) | post_abstract | (run >= 3) | (narrative & ((run >= 2) | (explicit & (run_chars >= 400))))


def content_kind(has_body: Column, has_abstract: Column) -> Column:
    return F.when(has_body, "fulltext").when(has_abstract, "abstract_only").otherwise("metadata_only")


def confidence(kind: Column, hard_negative: Column, access_gate: Column, insufficient: Column, weak: Column, losses: Column) -> Column:
    """Low unless full text without signals against it; medium for weak structure or lost content; else high."""
    low = (kind != "fulltext") | hard_negative | access_gate | insufficient
    return F.when(low, "low").when(weak | (losses > 0), "medium").otherwise("high")


def weak_structure(words: Column, chars: Column, explicit: Column, post_abstract: Column, blocks: Column, headings: Column) -> Column:
    return ((words > 0) | (chars > 0)) & ~(explicit | post_abstract) & ~((blocks >= 2) & (headings >= 1))


def preview_acceptable(width: Column, height: Column) -> Column:
    return ((width >= 300) & (height >= 200)) | ((width >= 600) & (height >= 120) & (width * height >= 60_000))


def substantial_prose(text: Column) -> Column:
    t = normalize_text(text)
    return (F.length(t) >= 80) | (F.size(F.split(t, r"(?<=[.!?])[ \n]+")) >= 2)


def status_rollup(errors: Column, limited: Column, ok: Column, total: Column) -> Column:
    return F.when(errors > 0, "error").when((limited > 0) & (ok == 0), "rate_limited").when((ok == total) & (total > 0), "ready").when(ok > 0, "partial").otherwise("not_configured")
