"""XML articles, MathML, LaTeX, Markdown images, citations and image headers: row functions for Arrow batches."""

from __future__ import annotations

import html
import re
import struct
import unicodedata
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s+")


def _clean(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


#: Elements inside each other that a document may have; the renderers recurse.
DEEPEST = 200


def parse_xml(text: str | None) -> ET.Element | None:
    """The root, or None for text that is no XML, that declares a document type or entities, or that nests too deeply."""
    if not text or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        root = ET.fromstring(text.encode())
    except (ET.ParseError, ValueError):
        return None
    return root if _depth(root) <= DEEPEST else None


def _depth(root: ET.Element) -> int:
    depth, level = 0, [root]
    while level:
        depth += 1
        level = [k for e in level for k in e]
    return depth


# ------------------------------------------------------------------ MathML

_ACCENTS = {"^": "hat", "ˆ": "hat", "¯": "bar", "‾": "bar", "~": "tilde", "˜": "tilde", "→": "vec", "˙": "dot", "¨": "ddot"}
_SIGNS = {"×": r"\times", "·": r"\cdot", "≤": r"\le", "≥": r"\ge", "≠": r"\ne", "±": r"\pm", "→": r"\to", "∞": r"\infty", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∈": r"\in", "≈": r"\approx", "−": "-", "√": r"\sqrt{}"}
_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho varsigma sigma tau upsilon phi chi psi omega".split()


def _sign(text: str) -> str:
    out = []
    for c in text:
        if c in _SIGNS:
            out.append(_SIGNS[c])
        elif "α" <= c <= "ω":
            out.append("\\" + _GREEK[ord(c) - ord("α")])
        else:
            out.append(c)
    return " ".join(out) if any(x.startswith("\\") for x in out) else "".join(out)


def mathml(e: ET.Element) -> str:
    """LaTeX of a MathML element; unknown elements give the LaTeX of their children."""
    kind = _name(e)
    kids = list(e)
    part = [mathml(k) for k in kids]
    inner = " ".join(x for x in part if x)
    arg = lambda i: "{" + (part[i] if i < len(part) else "") + "}"
    match kind:
        case "mi" | "mn" | "mo":
            text = _clean(e.text)
            if kind == "mi" and len(text) > 1 and text.isascii() and text.isalpha():
                return rf"\mathrm{{{text}}}"
            return _sign(text)
        case "mtext" | "ms":
            return rf"\text{{{_clean(e.text)}}}" if _clean(e.text) else ""
        case "mfrac":
            return rf"\frac{arg(0)}{arg(1)}"
        case "msqrt":
            return rf"\sqrt{{{inner}}}"
        case "mroot":
            return rf"\sqrt[{part[1] if len(part) > 1 else ''}]{arg(0)}"
        case "msup":
            return f"{part[0] if part else ''}^{arg(1)}"
        case "msub" | "munder":
            return f"{part[0] if part else ''}_{arg(1)}"
        case "msubsup" | "munderover":
            return f"{part[0] if part else ''}_{arg(1)}^{arg(2)}"
        case "mover":
            mark = _clean(kids[1].text) if len(kids) > 1 else ""
            return rf"\{_ACCENTS[mark]}{arg(0)}" if mark in _ACCENTS else rf"\overset{arg(1)}{arg(0)}"
        case "mfenced":
            left, right, by = e.get("open", "("), e.get("close", ")"), (e.get("separators", ",") or " ").strip()[:1]
            return rf"\left{left} {f'{by} '.join(part)} \right{right}"
        case "mtable":
            return r"\begin{matrix} " + r" \\ ".join(part) + r" \end{matrix}"
        case "mtr" | "mlabeledtr":
            return " & ".join(part)
        case "mspace" | "mphantom" | "annotation" | "annotation-xml":
            return ""
    return inner


def mathml_to_latex(text: str | None) -> str | None:
    root = parse_xml(text)
    return None if root is None else _SPACE.sub(" ", mathml(root)).strip()


_LATEX_RULES = [
    (re.compile(r"^\s*(\$\$?|\\\(|\\\[)|(\$\$?|\\\)|\\\])\s*$"), ""),
    (re.compile(r"\\(?:dfrac|tfrac)(?![A-Za-z])"), r"\\frac"),
    (re.compile(r"\\(?:leq)(?![A-Za-z])"), r"\\le"),
    (re.compile(r"\\(?:geq)(?![A-Za-z])"), r"\\ge"),
    (re.compile(r"\\(?:neq)(?![A-Za-z])"), r"\\ne"),
    (re.compile(r"\\(?:rm|mathnormal)(?![A-Za-z])\s*"), ""),
    (re.compile(r"\\(?:,|;|:|!|quad|qquad)(?![A-Za-z])"), " "),
    (re.compile(r"\s+"), " "),
    (re.compile(r"\s*([_^])\s*"), r"\1"),
    (re.compile(r"\{ +"), "{"),
    (re.compile(r" +\}"), "}"),
]


def normalize_latex(text: str | None) -> str:
    """One spelling: no delimiters, no spacing commands, usual names of relations, single spaces."""
    out = text or ""
    for pattern, by in _LATEX_RULES:
        out = pattern.sub(by, out)
    return out.strip()


# ------------------------------------------------------------------ JATS

_DROP = frozenset(("disp-formula", "inline-formula", "table-wrap", "fig", "fig-group", "xref-group"))


def _text(e: ET.Element) -> str:
    parts = [e.text or ""]
    for k in e:
        kind = _name(k)
        if kind not in _DROP:
            inner = _text(k)
            parts.append(f"<{kind}>{inner}</{kind}>" if kind in ("sup", "sub") else f"*{inner}*" if kind == "italic" else f"**{inner}**" if kind == "bold" else inner)
        parts.append(k.tail or "")
    return "".join(parts)


def _sections(e: ET.Element, level: int, out: list[str]) -> None:
    for k in e:
        kind = _name(k)
        if kind == "sec":
            title = next((_clean(_text(t)) for t in k if _name(t) == "title"), "")
            if title:
                out.append(f"{'#' * min(level, 6)} {title}")
            _sections(k, level + 1, out)
        elif kind == "p":
            if text := _clean(_text(k)):
                out.append(text)
        elif kind == "list":
            out.extend(f"- {text}" for item in k if (text := _clean(_text(item))))
        elif kind in ("boxed-text", "disp-quote"):
            _sections(k, level, out)


def jats(text: str | None) -> dict | None:
    """Title, journal, DOI, date, authors, keywords, licences, abstract, Markdown body and references of an article."""
    root = parse_xml(text)
    if root is None:
        return None
    every = lambda name, e=root: [x for x in e.iter() if _name(x) == name]
    first = lambda name, e=root: next((x for x in every(name, e)), None)
    said = lambda e: "" if e is None else _clean(_text(e))
    front = first("front")
    front = root if front is None else front
    dates = {d.get("pub-type") or d.get("date-type") or "": d for d in every("pub-date", front)}
    day = next((dates[k] for k in ("epub", "ppub", "collection", *dates) if k in dates), None)
    date = "" if day is None else " ".join(said(first(k, day)) for k in ("day", "month", "year") if first(k, day) is not None)
    authors = []
    for c in every("contrib", front):
        if c.get("contrib-type", "author") == "author":
            name = " ".join(x for x in (said(first("given-names", c)), said(first("surname", c))) if x) or said(first("collab", c))
            if name and name not in authors:
                authors.append(name)
    body: list[str] = []
    for part in ("body", "back"):
        if (e := first(part)) is not None:
            _sections(e, 2, body)
    refs = []
    for i, r in enumerate(every("ref")):
        doi = next((_clean(x.text) for x in every("pub-id", r) if x.get("pub-id-type") == "doi"), "")
        refs.append({"label": said(first("label", r)) or str(i + 1), "raw": _clean(" ".join(r.itertext())), "doi": doi.lower(), "year": said(first("year", r))})
    abstract = first("abstract", front)
    return {
        "title": said(first("article-title", front)),
        "journal_title": said(first("journal-title", front)),
        "doi": next((_clean(x.text).lower() for x in every("article-id", front) if x.get("pub-id-type") == "doi"), ""),
        "published": date,
        "authors": authors,
        "keywords": [said(k) for k in every("kwd", front)],
        "license_urls": [u for x in every("license") for k, u in x.attrib.items() if k.rsplit("}", 1)[-1] == "href"],
        "abstract": "" if abstract is None else _clean(" ".join(said(p) for p in every("p", abstract)) or said(abstract)),
        "markdown": "\n\n".join(body),
        "references": refs,
    }


JATS = "title string, journal_title string, doi string, published string, authors array<string>, keywords array<string>, license_urls array<string>, abstract string, markdown string, references array<struct<label:string,raw:string,doi:string,year:string>>"


# ------------------------------------------------------------------ Markdown images and citations


def markdown_images(text: str | None) -> list[dict]:
    """``start, end, alt, url, title`` of each image; brackets and parentheses may nest."""
    text, out, at = text or "", [], 0
    while (at := text.find("![", at)) >= 0:
        close = _balanced(text, at + 1, "[", "]")
        if close < 0 or close + 1 >= len(text) or text[close + 1] != "(":
            at += 2
            continue
        end = _balanced(text, close + 1, "(", ")")
        if end < 0:
            at += 2
            continue
        inside = text[close + 2 : end].strip()
        m = re.fullmatch(r"""<?(.*?)>?(?:\s+["'](.*)["'])?""", inside, re.S)
        out.append({"start": at, "end": end + 1, "alt": text[at + 2 : close], "url": m[1], "title": m[2] or ""})
        at = end + 1
    return out


def _balanced(text: str, at: int, left: str, right: str) -> int:
    """Place of the bracket that closes the one at ``at``; a bracket behind a backslash counts as text."""
    depth = 0
    for m in re.compile(r"\\.|[%s%s]" % (re.escape(left), re.escape(right)), re.S).finditer(text, at):
        depth += (m[0] == left) - (m[0] == right)
        if depth == 0:
            return m.start()
    return -1


def strip_images(text: str | None) -> str:
    text = text or ""
    for m in reversed(markdown_images(text)):
        text = text[: m["start"]] + text[m["end"] :]
    return text


_CITE = re.compile(r"\[(\d+[a-z]?(?:\s*[-–—−]\s*\d+[a-z]?)?(?:\s*,\s*\d+[a-z]?(?:\s*[-–—−]\s*\d+[a-z]?)?)*)\](?!\()")


def citations_to_sup(text: str | None) -> str:
    """Bracketed numbers and ranges become ``<sup>``; links are left alone."""
    return _CITE.sub(lambda m: "<sup>" + re.sub(r"\s*,\s*", ", ", re.sub(r"\s*[-–—−]\s*", "–", m[1])) + "</sup>", text or "")


def fold_accents(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()


def nfkc(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


def unescape(text: str | None) -> str:
    return _clean(html.unescape(text or "").replace("\xa0", " "))


_FENCE = re.compile(r"^\s*(```|~~~)")


def normalize_markdown(text: str | None) -> str:
    """Prose lines collapse, fenced, indented and table lines stay; at most one blank line in a row."""
    out: list[str] = []
    fenced = False
    for line in (text or "").replace("\r\n", "\n").replace("\xa0", " ").split("\n"):
        fence = bool(_FENCE.match(line))
        keep = fenced or fence or line.startswith(("    ", "\t")) or line.lstrip().startswith("|")
        fenced ^= fence
        line = line.rstrip() if keep else re.sub(r"[ \t]+", " ", line).strip()
        if line or fenced or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip("\n")


# ------------------------------------------------------------------ images


def image_info(body: bytes | None) -> dict | None:
    """MIME type, width and height from the first bytes; None where they are no known image."""
    b = bytes(body or b"")
    if b.startswith(b"\x89PNG\r\n\x1a\n") and len(b) >= 24:
        w, h = struct.unpack(">II", b[16:24])
        return {"mime": "image/png", "width": w, "height": h}
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        w, h = struct.unpack("<HH", b[6:10])
        return {"mime": "image/gif", "width": w, "height": h}
    if b.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 < len(b) and b[at] == 0xFF:
            if b[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return {"mime": "image/jpeg", "width": w, "height": h}
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
        return {"mime": "image/jpeg", "width": None, "height": None}
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return {"mime": "image/webp", "width": None, "height": None}
    return None


def arrow(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function that applies ``f`` to each value of an Arrow batch."""

    def call(c: Column) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([f(x) for x in s], index=s.index)

        return run(c)

    return call


def structs(f: Callable, fields: str) -> Callable[[Column], Column]:
    """The same for a function that gives a dict (or None): a struct column, through JSON."""

    def call(c: Column) -> Column:
        import json

        return F.from_json(arrow(lambda x: None if (r := f(x)) is None else json.dumps(r), "string")(c), fields)

    return call
