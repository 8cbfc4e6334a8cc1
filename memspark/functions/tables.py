"""Tables in texts: answers as Markdown, and Markdown tables read back. Native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.text import let, strip

#: Rows that an answer shows.
SHOWN_ROWS = 200
#: The columns of a listing and the names that headers may have for them, the first of them in two parts.
FIRST_NAMES, LAST_NAMES = ("first name", "firstname", "first"), ("last name", "lastname", "last")
LISTED = {"Email": ("email", "e-mail"), "Department": ("department", "dept"), "Position": ("position", "title", "role")}
#: Stands for an escaped bar while a line is split.
_BAR = "\x01"


def escaped_cell(c: Column) -> Column:
    """A cell of a Markdown table: bars escaped, one line."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escaped_cell), " | "), F.lit(" |"))


def header_index(headers: Column, names: tuple[str, ...]) -> Column:
    """Place of the first header that contains one of the names, underscores read as blanks; null if none does."""
    plain = F.transform(headers, lambda h: F.replace(F.lower(h), F.lit("_"), F.lit(" ")))
    hit = lambda h: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(h, n))
    return F.nullif(F.array_position(F.transform(plain, hit), True), F.lit(0)).cast("int")


def listed_rows(table: Column) -> Column:
    """Array of (name, email, department, position) of a table's rows; a missing column is empty.

    The name is the first and last name, or the first column where there aren't both.
    """
    places = F.array(*[header_index(table["headers"], n) for n in (FIRST_NAMES, LAST_NAMES, *LISTED.values())])
    cell = lambda row, at: F.coalesce(F.get(row, at - 1), F.lit(""))

    def listed(row: Column, at: Column) -> Column:
        first, last = F.get(at, F.lit(0)), F.get(at, F.lit(1))
        name = F.when(first.isNotNull() & last.isNotNull(), strip(F.concat_ws(" ", cell(row, first), cell(row, last)))).otherwise(cell(row, F.lit(1)))
        return F.array(name, *[cell(row, F.get(at, F.lit(2 + k))) for k in range(len(LISTED))])

    return let(places, lambda at: F.transform(table["rows"], lambda row: listed(row, at)))


def table_answer(title: Column, path: Column, table: Column) -> Column:
    """The answer to a listing request: how many rows, the source, and the first rows as a Markdown table."""
    n = F.size(table["rows"])
    lines = F.concat(F.array(markdown_row(F.array(F.lit("Name"), *map(F.lit, LISTED))), F.lit("| " + " | ".join(["---"] * (1 + len(LISTED))) + " |")), F.transform(F.slice(listed_rows(table), 1, SHOWN_ROWS), markdown_row))
    head = F.concat(F.lit("Found "), n.cast("string"), F.lit(" row(s) in `"), title, F.lit("`.\n\nSource: `"), path, F.lit("`\n\n"))
    rest = F.when(n > SHOWN_ROWS, F.concat(F.lit(f"\nShowing the first {SHOWN_ROWS} of "), n.cast("string"), F.lit(" rows.\n"))).otherwise("")
    return F.concat(head, F.array_join(lines, "\n"), F.lit("\n"), rest)


def markdown_cells(line: Column) -> Column:
    """Cells of a line of a Markdown table: split at bars that aren't escaped, outer bars left out, stripped."""
    marked = F.regexp_replace(strip(F.replace(line, F.lit("\\|"), F.lit(_BAR))), r"^\||\|$", "")
    return F.transform(F.split(marked, r"\|"), lambda c: F.replace(strip(c), F.lit(_BAR), F.lit("|")))


def markdown_tables(text: Column) -> Column:
    """All Markdown tables of a text, in order, as structs (headers, rows).

    A header is a line with a bar before a rule of as many cells (dashes, colons at their ends); rows are
    the lines with a bar that follow, up to the first without one. Ragged rows are cut or filled with empty cells.
    The lines are folded one by one with a state: outside, below a possible header, or in a table's body.
    """
    row_type = "array<array<string>>"
    kind = f"struct<headers:array<string>,rows:{row_type}>"
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast("array<string>").alias("header"), F.lit(False).alias("body"), F.array().cast(row_type).alias("rows"))

    def step(a: Column, line: Column) -> Column:
        return let(F.struct(markdown_cells(line).alias("cells"), F.contains(line, F.lit("|")).alias("barred")), lambda x: moved(a, x["cells"], x["barred"]))

    def moved(a: Column, cells: Column, barred: Column) -> Column:
        n = F.size(a["header"])
        rule = F.forall(cells, lambda c: c.rlike("^:?-+:?$")) & barred & (F.size(cells) == n)
        stays, opens = a["body"] & barred, ~a["body"] & F.coalesce(rule, F.lit(False))
        closed = F.when(a["body"] & ~barred, F.concat(a["done"], F.array(F.struct(a["header"].alias("headers"), a["rows"].alias("rows"))))).otherwise(a["done"])
        header = F.when(stays | opens, a["header"]).when(barred, cells)
        padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), F.lit(1), n)
        rows = F.when(stays, F.concat(a["rows"], F.array(padded))).otherwise(F.array().cast(row_type))
        return F.struct(closed.alias("done"), header.alias("header"), (stays | opens).alias("body"), rows.alias("rows"))

    lines = F.concat(F.split(text, "\r?\n"), F.array(F.lit("")))  # an empty line closes what is open
    return F.aggregate(lines, zero, step, lambda a: a["done"])
