"""Abstracts: near-duplicate blocks, and body paragraphs that repeat them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

#: Similarity and length difference up to which two abstracts, or a paragraph and an abstract, are one (fixed values).
SAME_ABSTRACT, SAME_PARAGRAPH, LENGTH_DELTA = 0.995, 0.989, 64


def _key(text: str) -> str:
    return "".join(c for c in " ".join(text.split()).lower() if c.isalnum())


def alike(a: str, b: str, least: float) -> bool:
    """Equal keys; or lengths within the difference and a matcher ratio of at least ``least``."""
    x, y = _key(a), _key(b)
    if not x or not y:
        return False
    if x == y:
        return True
    if abs(len(x) - len(y)) > LENGTH_DELTA:
        return False
    m = SequenceMatcher(None, x, y)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def distinct_blocks(blocks: list[str]) -> list[str]:
    """Blocks in order, without those alike to an earlier one."""
    out: list[str] = []
    for b in blocks:
        if b.strip() and not any(alike(b, o, SAME_ABSTRACT) for o in out):
            out.append(b)
    return out


def strip_leading(paragraphs: list[str], abstracts: list[str]) -> list[str]:
    """Paragraphs without the leading ones that repeat an abstract."""
    n = 0
    while n < len(paragraphs) and any(alike(paragraphs[n], a, SAME_PARAGRAPH) for a in abstracts):
        n += 1
    return paragraphs[n:]


def distinct_abstracts(rows: DataFrame, key: str, order: str = "pos", text: str = "text") -> DataFrame:
    """``key, pos, text``: per document the abstract blocks that no earlier one repeats. Documents have few."""
    kind = dict(rows.dtypes)[key]

    def keep(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        held: list[str] = []
        mask = []
        for t in f[text].fillna(""):
            new = bool(t.strip()) and not any(alike(t, o, SAME_ABSTRACT) for o in held)
            mask.append(new)
            if new:
                held.append(t)
        return f[mask][[key, order, text]]

    return rows.select(key, order, text).groupBy(key).applyInPandas(keep, f"{key} {kind}, {order} {dict(rows.dtypes)[order]}, {text} string")
