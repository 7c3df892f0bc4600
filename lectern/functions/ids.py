"""Identifiers, URLs, dates and citation numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import first_non_empty, normalize_text

DOI = r"(10\.[0-9]{4,9}/[^\s\"'<>]+)"
_DASHES = "‐‑‒–—−"


def clean_doi(c: Column) -> Column:
    """Lower case, one kind of dash, no resolver or label in front, no spaces, no closing marks."""
    c = F.translate(F.lower(normalize_text(c)), _DASHES, "-" * len(_DASHES))
    c = F.regexp_replace(c, r"^(https?://)?(dx\.)?doi\.org/|^doi:[ ]*", "")
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), r"[).,;]+$", "")


def extract_doi(c: Column) -> Column:
    found = F.regexp_extract(c, DOI, 1)
    return F.when(found != "", clean_doi(F.regexp_replace(found, r"[).,;]+$", "")))


def doi_needs_cleaning(c: Column) -> Column:
    c = normalize_text(c)
    return (c != "") & (c.rlike(r"[^\x00-\x7f]") | c.rlike(r"^(https?://|doi:)") | c.rlike(r"[ \t\n]"))


def arxiv_id(c: Column) -> Column:
    """Id without version from a bare id, a label, a DOI or a URL."""
    found = F.regexp_extract(F.lower(c), r"(?:arxiv[:./]|arxiv\.org/(?:abs|pdf)/|^)[ ]*([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})", 1)
    return F.when(found != "", found)


def host(c: Column) -> Column:
    """Lower-cased host of a URL without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_http_url(c: Column) -> Column:
    return F.coalesce(normalize_text(c).rlike(r"^(?i)https?://[^/?#]+"), F.lit(False))


#: Paths of machine interfaces (fixed values).
_API_PATHS = ("/content/abstract/", "/content/article/", "/inward/record.uri", "/inward/citedby.uri")


def is_api_url(c: Column, hosts: tuple[str, ...] = ("scopus.com", "www.scopus.com")) -> Column:
    h, p = host(c), F.lower(path(c))
    found = h.isin(*hosts) | F.startswith(h, F.lit("api."))
    for token in _API_PATHS:
        found = found | F.contains(p, F.lit(token))
    return (h != "") & found


def public_url(*columns: Column) -> Column:
    """The first URL that is not one of a machine interface, else the first."""
    urls = F.array_distinct(F.filter(F.array(*columns), lambda x: F.coalesce(x, F.lit("")) != ""))
    public = F.filter(urls, lambda x: ~is_api_url(x))
    return F.coalesce(F.get(public, 0), F.get(urls, 0))


def host_matches(h: Column, domain: Column) -> Column:
    return (h == domain) | F.endswith(h, F.concat(F.lit("."), domain))


def redact_url(c: Column) -> Column:
    """Values of key-like query parameters become ``***``."""
    return F.regexp_replace(c, r"(?i)([?&](?:api_?key|token|apikey|access_token|key|signature|sig|password)=)[^&#]*", "$1***")


def largest_in_srcset(c: Column) -> Column:
    """The candidate of the largest width, or density times 1000; of equal ones the last."""
    parts = F.transform(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x, i: F.struct(_score(x).alias("s"), i.alias("i"), F.split(x, "[ \t\n]+")[0].alias("u")))
    return F.array_max(parts)["u"]


def _score(x: Column) -> Column:
    w, d = F.regexp_extract(x, r"([0-9]+)w$", 1), F.regexp_extract(x, r"([0-9.]+)x$", 1)
    return F.when(w != "", w.cast("double")).when(d != "", d.cast("double") * 1000).otherwise(F.lit(0.0))


#: Extensions of content types (fixed values).
_EXTENSIONS = {
    "application/pdf": ".pdf", "application/xml": ".xml", "text/xml": ".xml", "text/html": ".html", "application/json": ".json", "text/plain": ".txt",
    "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/svg+xml": ".svg", "image/webp": ".webp", "image/tiff": ".tif",
}


def extension(content_type: Column, url: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _EXTENSIONS.items() for x in pair])
    kind = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    suffix = F.lower(F.regexp_extract(path(url), r"(\.[A-Za-z0-9]{1,8})$", 1))
    return F.coalesce(F.try_element_at(known, kind), F.when(suffix != "", suffix), F.lit(".bin"))


def date_text(parts: Column) -> Column:
    """Year, month and day as they are, joined by dashes."""
    return F.when(F.size(parts) > 0, F.concat_ws("-", F.transform(parts, lambda x: x.cast("string"))))


def last_year(c: Column) -> Column:
    years = F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"))
    return F.try_element_at(years, F.lit(-1))


def retry_after_seconds(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).cast("long"))


def backoff_seconds(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2.0), attempt)


def citation_numbers(c: Column) -> Column:
    """``1,3-5`` as ``1, 3–5``; null unless all items are numbers or ranges."""
    items = F.transform(F.split(F.translate(normalize_text(c), "−—-", "–––"), ","), lambda x: F.trim(x))
    good = F.forall(items, lambda x: x.rlike("^[0-9]+[a-z]?( ?– ?[0-9]+[a-z]?)?$"))
    return F.when(good, F.array_join(F.transform(items, lambda x: F.regexp_replace(x, " ?– ?", "–")), ", "))


def transient_status(c: Column) -> Column:
    return c.between(500, 599)


def looks_like_pdf(content_type: Column, body: Column, url: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)) | F.coalesce(F.startswith(F.hex(body), F.lit("25504446")), F.lit(False)) | F.coalesce(F.endswith(F.lower(path(url)), F.lit(".pdf")), F.lit(False))


def decode_html(body: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(body.cast("string")), F.decode(body, "ISO-8859-1"))


def access_page_url(c: Column) -> Column:
    p = F.lower(path(c))
    return p.rlike("/doi/abs/|/abstract(/|$)|/login|/action/showlogin")


def figure_label(heading: Column, url: Column, caption: Column) -> Column:
    """``Figure n`` from the first of heading, file name and caption that tells a number."""
    pick = lambda c: F.regexp_extract(F.lower(c), r"(?:fig(?:ure)?s?)[ ._-]*([0-9]+[a-z]?)", 1)
    number = first_non_empty(pick(heading), pick(F.regexp_extract(path(url), "([^/]*)$", 1)), pick(caption))
    return F.when(number.isNotNull(), F.concat(F.lit("Figure "), number))
