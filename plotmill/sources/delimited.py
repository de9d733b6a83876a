"""Tab-separated lines: a quote-aware finite-state tokenizer that composes the transitions of chunks.

A line is cut into chunks at its tabs. Inside a chunk no tab can occur, so the tokenizer needs two states between
chunks: 0, at the start of a cell, and 1, inside a quoted cell. Each chunk is first turned, alone, into its transition
function: the state it leads to from 0 and from 1, or 2 for an error. Composing the functions from left to right gives
the cells' ends and the first error's offset, without looking at a character again. All of it is built-in JVM
expressions, linear in the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text up to the quote that ends a cell: quotes in it are doubled. Possessive, hence without backtracking or recursion.
_QUOTED = '^[^"]*+(?:""[^"]*+)*+'

#: Columns of a staged tracker row, with what a loaded value is cast to.
TRACKER_COLUMNS = (
    ("num", "int"), ("add_date", "date"), ("portal", "string"), ("offer_type", "string"), ("location", "string"), ("price", "double"),
    ("m2", "double"), ("rooms", "double"), ("score", "double"), ("status", "string"), ("report", "string"), ("notes", "string"),
)


def _from_quoted(chunk: Column) -> Column:
    """State after a chunk that begins inside a quoted cell."""
    rest = F.length(chunk) - F.length(F.regexp_extract(chunk, _QUOTED, 0))
    return F.when(rest == 0, 1).when(rest == 1, 0).otherwise(2)


def _transition(chunk: Column) -> Column:
    inner = F.substring(chunk, F.lit(2), F.length(chunk))
    return F.struct(
        F.length(chunk).alias("len"),
        F.when(chunk.startswith('"'), _from_quoted(inner)).otherwise(0).alias("from0"),
        _from_quoted(chunk).alias("from1"),
    )


def tokenize(line: Column, max_cells: int) -> Column:
    """Struct of a line: ``ends`` (0-based end of each cell, of the first ``max_cells + 1``), ``cells`` (their true
    count), ``bad`` (0-based offset of the cell with wrong quotes, or -1)."""
    start = F.struct(
        F.lit(0).alias("state"), F.lit(0).alias("pos"), F.lit(0).alias("cell"), F.lit(0).alias("cells"), F.lit(-1).alias("bad"), F.array().cast("array<int>").alias("ends"),
    )

    def step(a: Column, t: Column) -> Column:
        to = F.when(a["bad"] >= 0, 2).when(a["state"] == 0, t["from0"]).otherwise(t["from1"])
        end = a["pos"] + t["len"]
        done = to == 0
        return F.struct(
            to.alias("state"),
            (end + 1).alias("pos"),
            F.when(done, end + 1).otherwise(a["cell"]).alias("cell"),
            (a["cells"] + done.cast("int")).alias("cells"),
            F.when(a["bad"] >= 0, a["bad"]).when(to == 2, a["cell"]).otherwise(-1).alias("bad"),
            F.when(done & (a["cells"] <= max_cells), F.concat(a["ends"], F.array(end))).otherwise(a["ends"]).alias("ends"),
        )

    def finish(a: Column) -> Column:
        return F.struct(a["ends"].alias("ends"), a["cells"].alias("cells"), F.when((a["bad"] < 0) & (a["state"] == 1), a["cell"]).otherwise(a["bad"]).alias("bad"))

    return F.aggregate(F.transform(F.split(line, "\t", -1), _transition), start, step, finish)


def _cell(line: Column, tok: Column, k: int) -> Column:
    """Content of the k-th cell (0-based), quotes resolved; null if the line has fewer cells."""
    begin = F.lit(0) if k == 0 else F.get(tok["ends"], F.lit(k - 1)) + 1
    raw = F.substring(line, begin + 1, F.get(tok["ends"], F.lit(k)) - begin)
    return F.when(raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


def parse_tracker_lines(lines: DataFrame, line_id: str = "line_id", text: str = "line") -> DataFrame:
    """One row per line that isn't skipped: ``line_id``, ``reason`` (null for a valid row), ``offset`` (0-based offset in
    the line at which the reason shows) and the twelve cells as text (``c_num`` ... ``c_notes``; null with a reason).

    Skipped: null lines, lines of blanks (U+0020) only, empty ones included, and lines that begin with ``num`` and a
    tab. The first reason that applies is given: ``quotes``, ``columns`` (not 11 or 12 cells), ``num`` (after cutting
    outer blanks not 1 to 9 digits, or 0), ``notes`` (the twelfth cell holds a control character other than tab, U+007F
    or U+FFFD). Repeated lines are parsed each by itself; other columns of ``lines`` are ignored.
    """
    names = [n for n, _ in TRACKER_COLUMNS]
    raw = F.col("text")
    tok = F.col("tok")
    kept = lines.select(F.col(line_id).alias("line_id"), F.col(text).alias("text")).where(raw.isNotNull() & ~raw.rlike("^ *\\z") & ~raw.startswith("num\t"))
    cut = kept.withColumn("tok", tokenize(raw, len(names)))
    cells = cut.select("line_id", "text", "tok", *[_cell(raw, tok, k).alias(f"c_{n}") for k, n in enumerate(names)])
    num = F.trim(F.col("c_num"))
    foul = F.regexp_extract(F.col("c_notes"), "^[^\\x00-\\x08\\x0A-\\x1F\\x7F\\uFFFD]*+", 0)
    reason = (
        F.when(tok["bad"] >= 0, "quotes")
        .when(~tok["cells"].isin(11, 12), "columns")
        .when(~num.rlike("^[0-9]{1,9}\\z") | num.rlike("^0+\\z"), "num")
        .when(F.length(foul) < F.length("c_notes"), "notes")
    )
    at = (
        F.when(tok["bad"] >= 0, tok["bad"])
        .when(tok["cells"] < 11, F.length(raw))
        .when(tok["cells"] > 12, F.get(tok["ends"], F.lit(11)) + 1)
        .when(F.col("reason") == "num", 0)
        .when(F.col("reason") == "notes", F.get(tok["ends"], F.lit(10)) + 1)
    )
    return (
        cells.withColumn("reason", reason)
        .withColumn("offset", at)
        .select("line_id", "reason", "offset", *[F.when(F.col("reason").isNull(), F.col(f"c_{n}")).alias(f"c_{n}") for n in names])
    )


def line_errors(parsed: DataFrame) -> DataFrame:
    """``(line_id, reason, offset)`` of the lines that can't be loaded."""
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason", "offset")


def tracker_rows(parsed: DataFrame) -> DataFrame:
    """The valid lines as typed rows; a cell that isn't a value of its type becomes null, as other cells aren't checked."""
    from plotmill.functions.exact_numbers import exact_from_text

    def typed(name: str, kind: str) -> Column:
        cell = F.trim(F.col(f"c_{name}"))
        if kind == "double":
            return exact_from_text(cell).cast("double") if name != "score" else F.replace(cell, F.lit(","), F.lit(".")).try_cast("double")
        return cell.try_cast(kind) if kind != "string" else F.nullif(F.col(f"c_{name}"), F.lit(""))

    return parsed.where(F.col("reason").isNull()).select("line_id", *[typed(n, k).alias(n) for n, k in TRACKER_COLUMNS])
