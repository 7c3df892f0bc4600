"""Article XML in the ce: vocabulary, and CALS tables."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from lectern.operators.markup import _clean, _name, mathml, parse_xml
from lectern.operators.tables import place


def _inline(e: ET.Element) -> str:
    parts = [e.text or ""]
    for k in e:
        kind = _name(k)
        if kind == "math":
            parts.append(f"${mathml(k)}$")
        elif kind not in ("float-anchor", "footnote", "display"):
            inner = _inline(k)
            parts.append({"sup": f"<sup>{inner}</sup>", "inf": f"<sub>{inner}</sub>", "italic": f"*{inner}*", "bold": f"**{inner}**"}.get(kind, inner))
        parts.append(k.tail or "")
    return "".join(parts)


def _walk(e: ET.Element, level: int, out: list[str]) -> None:
    for k in e:
        kind = _name(k)
        if kind == "section":
            title = next((_clean(_inline(t)) for t in k if _name(t) == "section-title"), "")
            label = next((_clean(_inline(t)) for t in k if _name(t) == "label"), "")
            if title:
                out.append(f"{'#' * min(level, 6)} {' '.join(x for x in (label, title) if x)}")
            _walk(k, level + 1, out)
        elif kind in ("para", "simple-para"):
            if text := _clean(_inline(k)):
                out.append(text)
        elif kind == "list-item":
            if text := _clean(_inline(k)):
                out.append(f"- {text}")
        elif kind in ("sections", "list", "body", "acknowledgment", "appendices"):
            _walk(k, level, out)


def article(text: str | None) -> dict | None:
    """Title, DOI, authors, keywords, abstract, Markdown body and reference texts; None for what is no safe XML."""
    root = parse_xml(text)
    if root is None:
        return None
    every = lambda name, e=root: [x for x in e.iter() if _name(x) == name]
    said = lambda name, e=root: next((_clean(_inline(x)) for x in every(name, e)), "")
    authors: list[str] = []
    for a in every("author"):
        name = " ".join(x for x in (said("given-name", a), said("surname", a)) if x)
        if name and name not in authors:
            authors.append(name)
    body: list[str] = []
    for e in every("body")[:1]:
        _walk(e, 2, body)
    abstract = every("abstract")
    return {
        "title": said("title"),
        "doi": said("doi").lower(),
        "authors": authors,
        "keywords": [_clean(_inline(k)) for k in every("keyword")],
        "abstract": _clean(" ".join(_inline(p) for a in abstract[:1] for p in every("simple-para", a) + every("para", a))),
        "markdown": "\n\n".join(body),
        "references": [_clean(" ".join(r.itertext())) for r in every("bib-reference")],
    }


ARTICLE = "title string, doi string, authors array<string>, keywords array<string>, abstract string, markdown string, references array<string>"


def cals_cells(table: ET.Element) -> tuple[list[dict], bool]:
    """Cells with row, spans and header flag; and whether a column name was unknown, so that a span got lost."""
    names = {c.get("colname") or str(i + 1): i for i, c in enumerate(x for x in table.iter() if _name(x) == "colspec")}
    out, lossy, row = [], False, -1
    for part in (x for x in table.iter() if _name(x) in ("thead", "tbody", "tfoot")):
        for r in (x for x in part if _name(x) == "row"):
            row += 1
            for k, e in enumerate(x for x in r if _name(x) == "entry"):
                wide = 1
                if e.get("namest") and e.get("nameend"):
                    if e.get("namest") in names and e.get("nameend") in names:
                        wide = names[e.get("nameend")] - names[e.get("namest")] + 1
                    else:
                        lossy = True
                more = e.get("morerows", "0")
                out.append({"row": row, "cell": k, "text": _clean(_inline(e)), "is_header": _name(part) == "thead", "rowspan": 1 + (int(more) if more.isdigit() else 0), "colspan": max(1, wide)})
    return out, lossy


def cals_grid(text: str | None) -> dict | None:
    """``cells`` spread over the grid (row, col, text, header), or as a list where the table is ragged, and ``lossy``."""
    root = parse_xml(text)
    if root is None:
        return None
    cells, lossy = cals_cells(root)
    spots = place([(c["row"], c["rowspan"], c["colspan"]) for c in cells])
    if spots is None:
        return {"cells": [{"row": c["row"], "col": c["cell"], "text": c["text"], "is_header": c["is_header"]} for c in cells], "lossy": True}
    last = max((c["row"] for c in cells), default=-1)
    spread = [{"row": r + i, "col": at + j, "text": c["text"], "is_header": c["is_header"]} for c, (r, at) in zip(cells, spots, strict=True) for i in range(c["rowspan"]) for j in range(c["colspan"]) if r + i <= last]
    return {"cells": sorted(spread, key=lambda c: (c["row"], c["col"])), "lossy": lossy}


GRID = "cells array<struct<row:int,col:int,text:string,is_header:boolean>>, lossy boolean"


def lists_from_ragged(cells: list[dict]) -> list[str]:
    """A ragged table as ``header: value; ...`` lines, by position."""
    heads = [c["text"] for c in cells if c["is_header"]]
    rows: dict[int, list[str]] = {}
    for c in cells:
        if not c["is_header"]:
            rows.setdefault(c["row"], []).append(c["text"])
    return ["- " + "; ".join(f"{heads[i]}: {v}" if i < len(heads) else v for i, v in enumerate(r)) for r in rows.values()]


_LANGUAGE = re.compile(r"^[a-z]{2,3}(?:[-_][A-Za-z0-9]{2,8})*$")
#: Names of languages (fixed values).
LANGUAGES = {"english": "en", "french": "fr", "français": "fr", "german": "de", "deutsch": "de", "spanish": "es", "español": "es", "portuguese": "pt", "português": "pt", "chinese": "zh", "italian": "it"}


def language_hint(value: str | None) -> str | None:
    """Two-letter code from a code or a name."""
    v = (value or "").strip().lower()
    if v in LANGUAGES:
        return LANGUAGES[v]
    return re.split("[-_]", v)[0] if _LANGUAGE.match(v) else None
