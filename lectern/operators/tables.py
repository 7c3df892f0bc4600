"""Tables: span expansion, header flattening, aligned Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text, table_cell


def place(cells: list[tuple[int, int, int]]) -> list[tuple[int, int]] | None:
    """Row and column of the upper left corner of each cell ``(row, rowspan, colspan)``, given row by row.

    A cell takes the first free column of its row. None where cells leave a hole or overlap past the end.
    """
    taken: set[tuple[int, int]] = set()
    out, width, rows = [], 0, 0
    row, column = -1, 0
    for r, high, wide in cells:
        if r != row:
            row, column = r, 0
        while (r, column) in taken:
            column += 1
        out.append((r, column))
        taken |= {(r + i, column + j) for i in range(max(1, high)) for j in range(max(1, wide))}
        column += max(1, wide)
        width, rows = max(width, column), max(rows, r + 1)
    full = all((r, c) in taken for r in range(rows) for c in range(width))
    return out if full else None


def expand(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """``key, row, col, text, is_header``: each position of each table that its cells cover without a hole.

    ``cells`` has ``key, row, cell, text, is_header, rowspan, colspan``. Where a cell starts depends on
    those before it, so that a table is placed as a whole; spreading over its span is an explode.
    """

    @F.pandas_udf("array<int>")
    def columns(cells: pd.Series) -> pd.Series:
        return pd.Series([None if (spots := place([tuple(c) for c in some])) is None else [c for _, c in spots] for some in cells])

    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(1))
    cell = F.struct(F.col("row").cast("int").alias("row"), F.col("cell").cast("int").alias("cell"), "text", "is_header", number("rowspan").alias("rowspan"), number("colspan").alias("colspan"))
    whole = cells.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    at = columns(F.transform("cells", lambda c: F.array(c["row"], c["rowspan"], c["colspan"])))
    placed = whole.select(key, F.explode(F.arrays_zip("cells", at.alias("at"))).alias("c")).where("c.at IS NOT NULL")
    placed = placed.select(key, "c.cells.row", "c.at", "c.cells.text", "c.cells.is_header", "c.cells.rowspan", "c.cells.colspan")
    last = placed.groupBy(key).agg(F.max("row").alias("_last"))
    span = lambda n: F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1)
    spread = placed.withColumn("i", F.explode(span(F.col("rowspan")))).withColumn("j", F.explode(span(F.col("colspan"))))
    spread = spread.join(last, key).where(F.col("row") + F.col("i") <= F.col("_last"))
    return spread.select(key, (F.col("row") + F.col("i")).alias("row"), (F.col("at") + F.col("j")).alias("col"), "text", "is_header")


def header_rows(grid: DataFrame, key: str = "table_id") -> DataFrame:
    """Number of leading rows that are all header."""
    rows = grid.groupBy(key, "row").agg(F.min(F.col("is_header").cast("int")).alias("h"))
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("h") == 0, F.col("row"))), F.max("row") + 1).cast("long").alias("headers"))


def to_markdown(grid: DataFrame, key: str = "table_id") -> DataFrame:
    """Aligned Markdown: header rows flattened to ``A / B`` without repeats, columns padded to their longest cell."""
    rows = grid.join(header_rows(grid, key), key).withColumn("text", table_cell(normalize_text(F.col("text"))))
    above = F.lag("text").over(Window.partitionBy(key, "col").orderBy("row"))
    heads = rows.where("row < headers").withColumn("_above", above).where("_above IS NULL OR _above != text")
    named = heads.groupBy(key, "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " / ").alias("text")).withColumn("row", F.lit(-2))
    body = rows.where("row >= headers").select(key, "col", "text", "row")
    every = named.select(key, "col", "text", "row").unionByName(body)
    every = every.withColumn("_w", F.greatest(F.max(F.length("text")).over(Window.partitionBy(key, "col")), F.lit(3)))
    rule = named.select(key, "col").join(every.groupBy(key, "col").agg(F.max("_w").alias("_w")), [key, "col"]).select(key, "col", F.repeat(F.lit("-"), F.col("_w")).alias("text"), F.lit(-1).alias("row"), "_w")
    cells = every.unionByName(rule).withColumn("cell", F.rpad("text", F.col("_w"), F.lit(" ")))
    lines = cells.groupBy(key, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), " | ").alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |"))), "\n").alias("markdown"))


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, table, row, cell, text, is_header, rowspan, colspan`` from the tables of a page."""
    from html.parser import HTMLParser

    class Cells(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[dict] = []
            self.table = self.row = self.cell = -1
            self.open: dict | None = None

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "table":
                self.table, self.row = self.table + 1, -1
            elif tag == "tr":
                self.row, self.cell = self.row + 1, -1
            elif tag in ("td", "th") and self.table >= 0:
                a = dict(attrs)
                span = lambda k: int(a[k]) if (a.get(k) or "").isdigit() else 1
                self.cell += 1
                self.open = {"table": self.table, "row": max(self.row, 0), "cell": self.cell, "text": "", "is_header": tag == "th", "rowspan": span("rowspan"), "colspan": span("colspan")}
                self.out.append(self.open)
            elif tag == "br" and self.open:
                self.open["text"] += "\n"

        def handle_endtag(self, tag: str) -> None:
            if tag in ("td", "th", "tr", "table"):
                self.open = None

        def handle_data(self, data: str) -> None:
            if self.open:
                self.open["text"] += data

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for k, h in zip(f[key], f[html], strict=True):
                p = Cells()
                p.feed(h or "")
                p.close()
                found += [{key: k, **r} for r in p.out]
            yield pd.DataFrame(found, columns=[key, "table", "row", "cell", "text", "is_header", "rowspan", "colspan"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(parse, f"{key} {kind}, table int, row int, cell int, text string, is_header boolean, rowspan int, colspan int")
