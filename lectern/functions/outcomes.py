"""What became of a request, a result or an article, and what follows from it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let, normalize_text

# Words of an error's text that name its category.
CLOSED_WORDS = ("remote end closed", "connection aborted", "connection broken", "eof")
# What is advised for the categories of a drift report, the most urgent first.
ACTIONS = (
    (("access_gate", "challenge_or_rate_limit"), "rerun live later or update access review/runtime after operator inspection"),
    (("metadata_only_degradation",), "repair provider route or replace DOI sample if full text is no longer available"),
    (("pdf_fallback_silent_degradation", "source_mismatch"), "repair provider route-source handling before accepting live drift"),
    (("markdown_contract_issue",), "inspect Markdown output and update provider cleanup or contract after review"),
)
# Warnings about content that a conversion lost, with the counters that call for each.
LOSSES = (
    (("table_fallback",), "Some tables could only be retained as original-resource fallbacks; structured table data may be incomplete."),
    (("table_semantic_loss", "table_lossy"), "Some tables lost semantic content during Markdown conversion."),
    (("table_layout_degraded",), "Some tables were flattened lossily for Markdown output; merged-cell structure was not preserved exactly."),
    (("formula_fallback",), "Some formulas required degraded fallback rendering."),
    (("formula_missing",), "Some formulas could not be converted faithfully and were replaced with explicit placeholders."),
)
#: Words of a transparent text layer, and times the words of the visible one, that make it worth a second try.
TRANSPARENT_WORDS, TRANSPARENT_FACTOR = 500, 3


def http_failure(status: Column) -> Column:
    return F.when(status.isin(401, 403), "no_access").when(status == 404, "no_result").when(status == 429, "rate_limited").otherwise("error")


def network_error(kinds: Column, text: Column) -> Column:
    """Category of a network failure from the kinds of its causes (``timeout``, ``tls``, ``dns``) and their text."""

    def category(said: Column) -> Column:
        closed = F.lit(False)
        for w in CLOSED_WORDS:
            closed = closed | F.contains(said, F.lit(w))
        unresolved = F.contains(said, F.lit("temporary failure")) & F.contains(said, F.lit("name resolution"))
        named = F.when(F.array_contains(kinds, "timeout"), "timeout").when(F.array_contains(kinds, "tls"), "tls_error").when(F.array_contains(kinds, "dns"), "dns_error")
        return F.coalesce(named, F.when(F.contains(said, F.lit("connection reset")), "connection_reset").when(closed, "connection_closed").when(unresolved, "dns_error").otherwise("network_error"))

    return let(F.lower(F.coalesce(text, F.lit(""))), category)


def result_status(provider: Column, kind: Column, trail: Column) -> Column:
    """Status of a result from what it holds and, short of full text, from the steps of its trail."""
    step = lambda end: F.array_contains(trail, F.concat(F.lit("fulltext:"), provider, F.lit(f"_{end}")))
    return F.when(kind == "fulltext", "fulltext").when(step("not_configured"), "not_configured").when(step("rate_limited"), "rate_limited").when(step("fail") | step("not_usable"), "no_result").otherwise("metadata_only")


def review_status(status: Column, categories: Column) -> Column:
    return F.when(status == "unsupported_provider", "skipped").when(status != "fulltext", "blocked").when(F.size(categories) > 0, "issue").otherwise("ok")


def operator_action(categories: Column) -> Column:
    out = F.lit(None).cast("string")
    for names, advice in ACTIONS:
        out = F.coalesce(out, F.when(F.arrays_overlap(categories, F.array(*map(F.lit, names))), advice))
    return F.coalesce(out, F.lit("none"))


def diagnostic_kind(body_ok: Column, has_abstract: Column, blocked: Column) -> Column:
    """Kind of content that a page shows; signals that block it rule full text out."""
    return F.when(body_ok & ~blocked, "fulltext").when(has_abstract, "abstract_only").otherwise("metadata_only")


def transparent_fallback(usable: Column, words: Column, transparent: Column, raw: Column) -> Column:
    """Whether the transparent layer of a PDF is worth reading where the visible one was not usable."""
    return ~usable & (transparent >= TRANSPARENT_WORDS) & (raw >= TRANSPARENT_FACTOR * words)


def figure_mode(asked: Column, profile: Column) -> Column:
    return F.coalesce(asked, F.when(profile == "none", "captions_only").otherwise("inline"))


def supplementary_mode(asked: Column, profile: Column) -> Column:
    return F.coalesce(asked, profile == "all")


def asset_profile(asked: Column, of_provider: Column, of_source: Column) -> Column:
    """The profile asked for, else that of the provider, else that of the source."""
    return F.coalesce(asked, of_provider, of_source)


def allowed(provider: Column, allow_list: Column) -> Column:
    """Whether a provider may be used; no list allows all."""
    return allow_list.isNull() | F.coalesce(F.array_contains(allow_list, provider), F.lit(False))


def loss_warnings(counts: dict[str, Column]) -> Column:
    """Warnings that follow from counters of lost content."""
    some = [F.when(sum((F.coalesce(counts[n], F.lit(0)) for n in names if n in counts), F.lit(0)) > 0, said) for names, said in LOSSES]
    return F.filter(F.array(*some), lambda x: x.isNotNull())


def merged_metrics(own: dict[str, Column], diagnosed: dict[str, Column]) -> dict[str, Column]:
    """Body metrics of an article, or of its diagnostics where it has none; flags add up and figures take the greater count."""
    counters = ("chars", "words", "blocks", "headings", "figures")
    has = sum((F.coalesce(own[c], F.lit(0)) for c in counters), F.lit(0)) > 0
    out = {c: F.when(has, own[c]).otherwise(diagnosed[c]) for c in counters[:4]}
    out |= {c: F.when(has, own[c] | diagnosed[c]).otherwise(diagnosed[c]) for c in ("explicit", "post_abstract")}
    return out | {"figures": F.when(has, F.greatest(own["figures"], diagnosed["figures"])).otherwise(diagnosed["figures"])}


def front_matter(fields: dict[str, Column], source: Column, kind: Column, has_abstract: Column, tokens: Column) -> Column:
    """The header of a rendered article: known fields between rules, what it holds, and the title as heading."""
    line = lambda k, v: let(normalize_text(v), lambda t: F.when(t != "", F.concat(F.lit(f'{k}: "'), F.translate(t, '"', "'"), F.lit('"'))))
    said = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    truth = lambda c: F.when(c, "true").otherwise("false")
    title = let(normalize_text(fields["title"]), lambda t: F.when(t == "", "Untitled Article").otherwise(t))
    lines = [F.lit("---"), *[line(k, v) for k, v in fields.items()], F.concat(F.lit('source: "'), source, F.lit('"')), said("has_fulltext", truth(kind == "fulltext")), F.concat(F.lit('content_kind: "'), kind, F.lit('"'))]
    lines += [said("has_abstract", truth(has_abstract)), said("token_estimate", tokens.cast("string")), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit("")]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")
