"""Tables inside HTML text, taken apart with column expressions, page by page.

A page is cut before each tag that makes tables, rows or cells.  One fold over these pieces keeps the stack of
open tables, so nested tables, left-out end tags and text around an inner table land where they belong; a
second one lays cells that span rows or columns out as a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256  # steps of a fold whose results are gathered at once, so that long pages take proportional time
# The most columns and rows a cell can span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

def read_html_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: ``(path, html)``."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


# --- folds over arrays, as SQL text: one call to the JVM instead of one per operator ------------------

def _let(name: str, value: str, then: str) -> str:
    """SQL that works ``value`` out once and uses it by name."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _folded(items: str, state: str, step: str, made: str, of: str) -> str:
    """SQL for what a fold over ``items`` gathers: arrays of type ``of``, joined.

    ``step`` is the next state from ``s`` and the item ``k``; ``made`` is what the item adds, from the state after it.
    """
    nothing = f"CAST(array() AS ARRAY<{of}>)"
    moved = _let("s", _let("s", "i.s", step), f"named_struct('s', s, 'out', concat(i.out, {made}))")
    block = f"aggregate(slice(items, n, {BLOCK}), named_struct('s', a.s, 'out', {nothing}), (i, k) -> {moved})"
    merged = _let("r", block, "named_struct('s', r.s, 'out', concat(a.out, array(r.out)))")
    blocks = f"aggregate(sequence(1, greatest(size(items), 1), {BLOCK}), named_struct('s', {state}, 'out', array({nothing})), (a, n) -> {merged})"
    return _let("items", items, f"flatten({blocks}.out)")


def _starting(items: str, test: str, name: str, then: str) -> str:
    """SQL for the stretches of ``items`` that begin where ``test`` holds for ``x``; ``then`` is made of each, by ``name``."""
    starts = f"filter(transform(items, (x, i) -> IF({test}, i + 1, NULL)), x -> x IS NOT NULL)"
    stretch = "slice(items, start, coalesce(get(starts, i + 1), size(items) + 1) - start)"
    return _let("items", items, _let("starts", starts, f"transform(starts, (start, i) -> {_let(name, stretch, then)})"))


# --- pieces of a page ------------------------------------------------------------------------------

def _pieces(html: str, table: str, row: str, cell: str) -> str:
    """SQL for a page's pieces: kind of tag (capital: start, small: end), text up to the next such tag, spans."""
    tags = "|".join(t for t in (table, row, cell, "thead|tbody|tfoot" if cell else "") if t)
    clean = rf"regexp_replace({html}, r'(?is)<!--.*?-->|<(script|style)[^>]*>.*?</\1\s*>', '')"
    cut = rf"slice(split({clean}, r'(?i)<(?=/?(?:{tags})(?![a-z0-9]))'), 2, greatest(length({html}), 1))"
    # A tag ends at the first ">" outside quotes, or, with a quote left open, at the first one.
    whole = r"""regexp_extract(p, r'^[^"\x27>]*+(?:(?:"[^"]*+"|\x27[^\x27]*+\x27)[^"\x27>]*+)*+>', 0)"""
    tag = f"coalesce(nullif({whole}, ''), regexp_extract(p, r'^[^>]*>?', 0))"
    name = "lower(regexp_extract(tag, r'^/?([a-zA-Z0-9]+)', 1))"
    kinds = [("T", table), ("R", row), *([("C", cell)] if cell else [])]
    kind = "CASE " + " ".join(f"WHEN {name} RLIKE r'^(?:{t})$' THEN '{k}'" for k, t in kinds) + " ELSE 'G' END"

    def span(attribute: str, most: int) -> str:
        digits = rf"""regexp_extract(tag, r'(?i)[\s"\x27/]{attribute}\s*=\s*["\x27]?\s*0*([0-9]{{1,6}})', 1)"""
        return f"least(greatest(coalesce(CAST(nullif({digits}, '') AS INT), 1), 1), {most})"

    piece = f"""named_struct('tag', IF(startswith(tag, '/'), lower({kind}), {kind}), 'text', substr(p, length(tag) + 1),
        'wide', {span("colspan", MOST_COLUMNS)}, 'high', {span("rowspan", MOST_ROWS)})"""
    return f"transform({cut}, p -> {_let('tag', tag, piece)})"


_OPEN = "STRUCT<t: INT, r: INT, c: INT, in_row: BOOLEAN, in_cell: BOOLEAN, implied: BOOLEAN>"
_ENTRY = "STRUCT<t: INT, kind: INT, text: STRING, wide: INT, high: INT>"


def _frame(t: str = "f.t", r: str = "f.r", c: str = "f.c", in_row: str = "f.in_row", in_cell: str = "f.in_cell", implied: str = "false") -> str:
    return f"named_struct('t', {t}, 'r', {r}, 'c', {c}, 'in_row', {in_row}, 'in_cell', {in_cell}, 'implied', {implied})"


def _entries(pieces: str, lists: bool) -> str:
    """SQL for what stands in tables, in the order of the page: row marks (kind 0), cells (1), more text of the open cell (2).

    The state is the stack of open tables, each with the row and cell it has reached.  A new row ends an open
    cell and row, a new cell an open cell; a cell outside a row starts one; the end of a table ends all in it.
    Tables that are never closed end with the page.  In lists (``lists``) each row is its own cell.
    """
    rest, last = "slice(s.stack, 1, greatest(size(s.stack) - 1, 0))", "slice(s.stack, greatest(size(s.stack), 1), 1)"
    row = _frame(r="f.r + 1", c="0" if lists else "-1", in_row="true", in_cell="true" if lists else "false")
    cell = _frame(r="IF(f.in_row, f.r, f.r + 1)", c="IF(f.in_row, f.c + 1, 0)", in_row="true", in_cell="true", implied="NOT f.in_row")
    changed = f"CASE k.tag WHEN 'R' THEN {row} WHEN 'C' THEN {cell} WHEN 'c' THEN {_frame(in_cell='false')} ELSE {_frame(in_row='false', in_cell='false')} END"
    new = _frame("s.tables", "-1", "-1", "false", "false")
    stack = f"CASE k.tag WHEN 'T' THEN concat(s.stack, array({new})) WHEN 't' THEN {rest} ELSE concat({rest}, transform({last}, f -> {changed})) END"
    step = f"named_struct('stack', {stack}, 'tables', s.tables + IF(k.tag = 'T', 1, 0))"
    entry = lambda kind, text: f"named_struct('t', f.t, 'kind', {kind}, 'text', {text}, 'wide', k.wide, 'high', k.high)"
    mark, opened, more = entry(0, "''"), entry(1, "k.text"), entry(2, "k.text")
    made = f"""CASE WHEN k.tag = 'R' THEN array({mark}{", " + opened if lists else ""}) WHEN k.tag = 'C' AND f.implied THEN array({mark}, {opened})
        WHEN k.tag = 'C' THEN array({opened}) WHEN f.in_cell AND k.text <> '' THEN array({more}) ELSE CAST(array() AS ARRAY<{_ENTRY}>) END"""
    start = f"named_struct('stack', CAST(array() AS ARRAY<{_OPEN}>), 'tables', 0)"
    return _folded(pieces, start, step, f"flatten(transform({last}, f -> {made}))", _ENTRY)


# --- grids ------------------------------------------------------------------------------------------

_REACH = "STRUCT<col: INT, text: STRING, high: INT>"


def _spread(rows: str) -> str:
    """SQL for rows of cells as rows of texts: a cell stands in every row and column it spans.

    The state holds the cells that reach into the next row.  Columns free of them take the row's own cells
    in order; a free column before a reaching cell is NULL; no cell reaches below the last row.
    """
    own = "flatten(transform(k, c -> array_repeat(named_struct('text', c.text, 'high', c.high), c.wide)))"
    above = "get(transform(filter(s.reach, x -> x.col = c), x -> named_struct('col', c, 'text', x.text, 'high', x.high)), 0)"
    # As many columns before c are free as no cell reaches into; that is the number of the own cell.
    mine = "get(transform(slice(own, c + 1 - size(filter(s.reach, x -> x.col < c)), 1), x -> named_struct('col', c, 'text', x.text, 'high', x.high)), 0)"
    width = "greatest(size(own) + size(s.reach), coalesce(array_max(transform(s.reach, x -> x.col)) + 1, 0))"
    line = _let("own", own, f"IF({width} = 0, CAST(array() AS ARRAY<{_REACH}>), transform(sequence(0, {width} - 1), c -> coalesce({above}, {mine})))")
    # Columns at the end that nothing stands in are no columns.
    trimmed = _let("l", line, "slice(l, 1, coalesce(array_max(transform(l, x -> x.col)) + 1, 0))")
    reach = "transform(filter(l, x -> x.high > 1), x -> named_struct('col', x.col, 'text', x.text, 'high', x.high - 1))"
    step = _let("l", trimmed, f"named_struct('reach', {reach}, 'line', transform(l, x -> x.text))")
    start = f"named_struct('reach', CAST(array() AS ARRAY<{_REACH}>), 'line', CAST(array() AS ARRAY<STRING>))"
    return _folded(rows, start, step, "array(s.line)", "ARRAY<STRING>")


def largest_table(html: str, table: str = "table", row: str = "tr", cell: str = "t[dh]") -> Column:
    """The table with most rows x columns in column ``html`` as an array of rows of cell texts; the first one on ties.

    The same call reads lists: ``table="ul|ol", row="li", cell=""`` makes each item a one-cell row.  Nested tables are
    tables of their own, and their text is theirs alone.  End tags of rows and cells may be missing.  Cells that span
    columns or rows are repeated there.  A page without tables, or a missing one, gives NULL.
    """
    # One cell: its pieces of text in order.  One row: its cells.
    text = "array_join(transform(cell, x -> x.text), '')"
    one_cell = f"named_struct('text', {text}, 'wide', cell[0].wide, 'high', cell[0].high)"
    one_row = _starting("row", "x.kind = 1", "cell", one_cell)
    rows = _starting("filter(entries, x -> x.t = t)", "x.kind = 0", "row", one_row)
    plain = "transform(rows, k -> flatten(transform(k, c -> array_repeat(c.text, c.wide))))"
    grid = _let("rows", rows, f"IF(exists(rows, k -> exists(k, c -> c.high > 1)), {_spread('rows')}, {plain})")
    area = "size(grid) * coalesce(array_max(transform(grid, r -> size(r))), 0)"
    ranked = f"transform(sequence(0, tables - 1), t -> {_let('grid', grid, f'named_struct({chr(39)}area{chr(39)}, {area}, {chr(39)}place{chr(39)}, -t, {chr(39)}grid{chr(39)}, grid)')})"
    best = _let("tables", "array_max(transform(entries, x -> x.t)) + 1", f"IF(tables IS NULL, NULL, array_max({ranked}).grid)")
    found = F.expr(_let("entries", _entries(_pieces(f"`{html}`", table, row, cell), not cell), best))
    return F.transform(found, lambda r: F.transform(r, cell_text))


def cell_text(html: Column) -> Column:
    """Markup removed, common entities resolved, blank becomes NULL."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.nullif(F.trim(text), F.lit(""))


def table_rows(pages: DataFrame, html: str = "html", **tags: str) -> DataFrame:
    """One row per table row: the page's other columns, ``pos`` from 0 and ``cells``."""
    kept = [c for c in pages.columns if c != html]
    grids = pages.select(*kept, largest_table(html, **tags).alias("_grid"))
    return grids.select(*kept, F.posexplode("_grid").alias("pos", "cells"))


def long_table(pages: DataFrame, html: str = "html", header_rows: int = 3) -> DataFrame:
    """Cells of each page's largest table in long form: ``(…, pos, name, item)``.

    The last header row names the columns; ``pos`` counts body rows from 0.  Each page is handled
    on its own row, nothing is shuffled.
    """
    kept = [c for c in pages.columns if c != html]
    grids = pages.select(*kept, largest_table(html).alias("_grid"))
    body = F.slice("_grid", F.lit(header_rows + 1), F.greatest(F.size("_grid") - header_rows, F.lit(0)))
    rows = grids.where(F.size("_grid") > header_rows).select(
        *kept, F.element_at("_grid", header_rows).alias("_names"), F.posexplode(body).alias("pos", "_cells")
    )
    return rows.select(*kept, "pos", F.get("_cells", F.lit(0)).alias("first"),
                       F.explode(F.arrays_zip(F.col("_names").alias("name"), F.col("_cells").alias("item"))).alias("c")).select(
        *kept, "pos", "first", "c.name", "c.item"
    )
