"""Citations: path, place, lines and chunk in one string, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(text: Column) -> Column:
    """Percent-encoding of a URI component: a space is %20, and - _ . ! ~ * ' ( ) stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%2A", "*")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def citation(
    path: Column, index: Column, page_start: Column, page_end: Column, line_start: Column, line_end: Column,
    kind: Column, start: Column, end: Column, label: Column, cell_start: Column, cell_end: Column,
) -> Column:
    """``path``, then the page, slide, spine or sheet range, then the lines, then ``#index``. Null or zero places are left out."""

    def span(prefix: str, a: Column, b: Column) -> Column:
        first, last = _positive(a), _positive(b)
        return F.concat(F.lit(f":{prefix}"), first.cast("string"), F.when(last.isNotNull() & (last != first), F.concat(F.lit(f"-{prefix}"), last.cast("string"))).otherwise(F.lit("")))

    cell = lambda c: F.when(c.rlike(r"^[A-Z]+\d+$"), c)
    first_cell, last_cell = cell(cell_start), cell(cell_end)
    name = F.nullif(F.trim(label), F.lit(""))
    sheet = F.when(name.isNotNull(), F.concat(F.lit(":sheet="), encoded(name))).otherwise(F.coalesce(F.concat(F.lit(":sheet="), _positive(start).cast("string")), F.lit("")))
    cells = F.coalesce(F.concat(F.lit(":cells="), first_cell, F.when(last_cell.isNotNull() & (last_cell != first_cell), F.concat(F.lit("-"), last_cell)).otherwise(F.lit(""))), F.lit(""))
    place = (
        F.when(_positive(page_start).isNotNull(), span("p", page_start, page_end))
        .when((kind == "slide") & _positive(start).isNotNull(), span("slide", start, end))
        .when((kind == "epub") & _positive(start).isNotNull(), span("spine", start, end))
        .when(kind == "sheet", F.concat(sheet, cells))
        .otherwise(F.lit(""))
    )
    lines = F.coalesce(F.concat(F.lit(":L"), _positive(line_start).cast("string"), F.lit("-L"), _positive(line_end).cast("string")), F.lit(""))
    return F.concat(path, place, lines, F.lit("#"), index.cast("string"))


def of_chunks() -> Column:
    """The citation of a row of the chunks table."""
    names = "relative_path chunk_index page_start page_end line_start line_end location_kind location_start location_end location_label cell_start cell_end"
    return citation(*(F.col(c) for c in names.split()))


def cited_path(value: Column) -> Column:
    """The path of a citation: the chunk, the lines and the place taken off."""
    out = F.regexp_replace(value, r"#\d+$", "")
    for pattern in (r":L\d+-L\d+$", r":cells=[A-Z]+\d+(?:-[A-Z]+\d+)?$", r":sheet=[^:]+$", r":(?:p\d+(?:-p\d+)?|slide\d+(?:-slide\d+)?|spine\d+(?:-spine\d+)?)$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def cited_index(value: Column) -> Column:
    """The chunk of a citation, null where it has none."""
    return F.when(value.rlike(r"#\d+$"), F.regexp_extract(value, r"#(\d+)$", 1).cast("int"))
