"""Repair and cleaning of naively split delimited lines, as Column expressions.

A line is an array of cells. Unescaped separators inside text fields leave too many cells; the
helpers put the surplus back into the title and the long text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Cell count of a repaired dataset, position of its long text, cells kept after it."""

    cells: int
    text: int
    trailing: int
    dated_title: bool = False  # title at 3, dates at 4 and 5


# The two datasets with text overflow.
LAYOUTS = {
    "project": Layout(cells=20, text=16, trailing=3, dated_title=True),
    "organization": Layout(cells=25, text=4, trailing=20),
}
TITLE = 3

# Cells of four digits lose leading zeros. Project files use a year pattern instead
# (19.. or 20..), which never starts with a zero, so their cells stay as they are.
PADDED_NUMBER = r"^(?=\d{4}$)0+(?=\d)"
DATE_CELL = r"^\d{4}-\d{2}-\d{2}$"


def split_cells(line: Column) -> Column:
    return F.split(line, ";", -1)


def _date_or_empty(cell: Column) -> Column:
    return (cell == "") | cell.rlike(DATE_CELL)


def _cells(items: Column, start: Column | int, stop: Column | int) -> Column:
    """Half-open 0-based range of an array."""
    start = F.lit(start) if isinstance(start, int) else start
    stop = F.lit(stop) if isinstance(stop, int) else stop
    return F.slice(items, start + 1, stop - start)


def _joined(items: Column) -> Column:
    return F.array(F.array_join(items, ";"))


def repair_title(cells: Column, layout: Layout) -> Column:
    """Join the cells before the first pair of date cells into the title; null if there is no pair."""
    size = F.size(cells)
    first = TITLE + 1
    broken = (size > layout.cells) & ~(
        _date_or_empty(F.get(cells, F.lit(first))) & _date_or_empty(F.get(cells, F.lit(first + 1)))
    )
    spots = F.filter(
        F.sequence(F.lit(first), F.greatest(size - 2, F.lit(first))),
        lambda i: _date_or_empty(F.get(cells, i)) & _date_or_empty(F.get(cells, i + 1)),
    )
    at = F.get(spots, F.lit(0))
    fixed = F.concat(
        _cells(cells, 0, TITLE), _joined(_cells(cells, TITLE, at)), _cells(cells, at, size)
    )
    return F.when(~broken, cells).when(at.isNotNull(), fixed)


def repair_text(cells: Column, layout: Layout) -> Column:
    """Join surplus cells into the long text."""
    size = F.size(cells)
    end = size - layout.trailing
    fixed = F.concat(
        _cells(cells, 0, layout.text), _joined(_cells(cells, layout.text, end)), _cells(cells, end, size)
    )
    return F.when(size > layout.cells, fixed).otherwise(cells)


def pad(cells: Column, layout: Layout) -> Column:
    missing = F.greatest(F.lit(layout.cells) - F.size(cells), F.lit(0))
    return F.concat(cells, F.array_repeat(F.lit(""), missing))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable stands for it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repair(cells: Column, layout: Layout) -> Column:
    """All structural repairs of a line; null when the line cannot be repaired."""

    def sized(padded: Column) -> Column:
        return F.when(F.size(padded) == layout.cells, padded)

    def surplus(titled: Column) -> Column:
        return bind(repair_text(titled, layout), lambda c: bind(pad(c, layout), sized))

    if layout.dated_title:
        return bind(cells, lambda c: bind(repair_title(c, layout), surplus))
    return bind(cells, surplus)


# Characters counted as white space.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean_cell(cell: Column, dataset: str) -> Column:
    """Outer quotes off, tabs to blanks, triple quotes to one, trimmed, leading zeros off."""
    bare = F.replace(F.btrim(cell, F.lit('"')), F.lit("\t"), F.lit(" "))
    bare = F.btrim(F.replace(bare, F.lit('"""'), F.lit('"')), F.lit(BLANKS))
    return bare if dataset == "project" else F.regexp_replace(bare, PADDED_NUMBER, "")


def clean_cells(cells: Column, dataset: str) -> Column:
    """Clean every cell; the last one also loses quotes and commas, the first one quotes."""
    last = F.size(cells) - 1

    def cleaned(cell: Column, i: Column) -> Column:
        plain = clean_cell(cell, dataset)
        return (
            F.when(i == last, F.translate(plain, '",', ""))
            .when(i == 0, F.translate(plain, '"', ""))
            .otherwise(plain)
        )

    return F.transform(cells, cleaned)


def name_cells(df: DataFrame, header: list[str], keep: list[str], column: str = "cells") -> DataFrame:
    """Cells to string columns by header position: empty is null, short rows are filled with null,
    surplus cells are cut."""
    named = [
        F.nullif(F.get(F.col(column), F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(header)
    ]
    return df.select(*named, *keep)


def parse_lines(df: DataFrame, dataset: str, header: list[str], keep: list[str] = ()) -> DataFrame:
    """Raw lines (column ``value``) of a dataset to named string columns.

    The cells are produced by a generator that drops unrepairable lines, so they are computed once
    and not again for a filter or for every named column.
    """
    keep = list(keep)
    cells = split_cells(F.col("value"))
    if dataset in LAYOUTS:
        cells = repair(cells, LAYOUTS[dataset])
    cells = bind(cells, lambda c: F.when(c.isNotNull(), clean_cells(c, dataset)))
    rows = df.select(F.explode(F.array_compact(F.array(cells))).alias("cells"), *keep)
    return name_cells(rows, header, keep)
