"""Markdown forms: table rows, queue lines, sections and correspondence blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmill.functions.numbers import queue_number

#: Columns of the tracker, viewing and document tables.
TRACKER = ("num", "date", "portal", "type", "location", "price", "m2", "rooms", "score", "status", "report", "notes")
VIEWINGS = ("num", "listing", "date", "time", "address", "contact", "status", "notes")
DOCUMENTS = ("listing", "document", "prepared", "submitted", "confirmed", "expires", "notes")


def cells(line: Column) -> Column:
    """Cells of a table row, blanks cut; empty inner cells keep their place."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), "^\\||\\|\\z", ""), "\\|", -1), lambda c: F.trim(c))


def table_rows(lines: DataFrame, keep: list[str], columns: tuple[str, ...], text: str = "line", least: int | None = None) -> DataFrame:
    """Data rows of a table: lines that begin with a bar, aren't the header's rule, have ``least`` cells (by default all)
    and, in their first cell, digits. Cells beyond the columns are ignored, ``-`` is null."""
    need = len(columns) if least is None else least
    row = lines.select(*keep, cells(F.col(text)).alias("c")).where(F.col(text).rlike("^\\s*\\|") & (F.size("c") >= need) & F.get("c", F.lit(0)).rlike("^[0-9]+\\z"))
    return row.select(*keep, *[F.nullif(F.get("c", F.lit(k)), F.lit("-")).alias(n) for k, n in enumerate(columns)])


def table_line(columns: list[Column]) -> Column:
    """A table row; bars in cells become slashes."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.translate(F.coalesce(c.cast("string"), F.lit("")), "|\n", "/ ") for c in columns]), F.lit(" |"))


def queue_line(url: Column, source: Column, group: Column, title: Column, price: Column, m2: Column, rooms: Column, location: Column) -> Column:
    """A pending queue line; unknown numbers (null, 0) and an empty place leave no field."""
    clean = lambda c: F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "|", "/"), "\\s+", " "))
    number = lambda c, unit: F.when(c > 0, F.concat(F.regexp_replace(c.cast("decimal(12,2)").cast("string"), "\\.?0+\\z", ""), F.lit(unit)))
    return F.concat_ws(" | ", F.concat(F.lit("- [ ] "), url), *map(clean, (source, group, title)), number(price, " EUR"), number(m2, " m²"), number(rooms, " Zi"), F.nullif(clean(location), F.lit("")))


def queue_rows(lines: DataFrame, keep: list[str], text: str = "line") -> DataFrame:
    """Pending queue lines as rows. Fields after the title are told by their shape, in any order; the last one of no shape
    is the place. Rooms missing there are looked for in the title. Unknown numbers are 0, other lines give no row."""
    p = lines.where(F.col(text).startswith("- [ ]")).select(*keep, F.transform(F.split(F.col(text), "\\|"), lambda c: F.trim(c)).alias("p"))
    tail = F.slice("p", F.lit(5), F.greatest(F.size("p") - 4, F.lit(0)))
    shapes = {"price": "^[0-9][0-9.,]*\\s*EUR\\z", "m2": "^[0-9.,]+\\s*m²\\z", "rooms": "^[0-9]+(?:[.,][0-9]+)?\\s*Zi\\z"}
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))

    def of_shape(shape: str) -> Column:
        return queue_number(F.regexp_replace(last(F.filter(tail, lambda f: f.rlike(shape))), "\\s*(EUR|m²|Zi)\\z", ""))

    shaped = {c: of_shape(s) for c, s in shapes.items()}
    place = last(F.filter(tail, lambda f: (f != "") & ~f.rlike("|".join(f"(?:{s})" for s in shapes.values()))))
    title = F.coalesce(F.get("p", F.lit(3)), F.lit(""))
    from_title = queue_number(F.regexp_extract(title, "(?i)([0-9]+(?:[.,][0-9]+)?)[\\s-]*(?:Zi|Zimmer|Raum|Räume)", 1))
    return p.select(
        *keep,
        F.regexp_extract(F.get("p", F.lit(0)), "https?://[^\\s|]+", 0).alias("url"),
        *[F.coalesce(F.get("p", F.lit(k)), F.lit("")).alias(n) for k, n in ((1, "source"), (2, "group"))],
        title.alias("title"),
        shaped["price"].alias("price"),
        shaped["m2"].alias("m2"),
        F.when(shaped["rooms"] != 0, shaped["rooms"]).otherwise(from_title).alias("rooms"),
        F.lower(place).alias("location"),
    )


_HEADER = "^##\\s+([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\\s+([0-9]{1,2}:[0-9]{2}))?\\s*·\\s*([^·]+?)\\s*·\\s*(?:[←→]\\s*)?(\\S+)\\s*\\z"


def correspondence(texts: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """Blocks of correspondence logs: ``row_id, block, day, time, channel, direction, next``.

    A dated ``##`` header opens a block, any other ``##`` line closes it; the block's first ``**Next:**`` line counts.
    Lines are numbered inside each text, so the order needs no sort over all texts.
    """
    lines = texts.where(F.col(row_id).isNotNull()).select(row_id, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    head = F.col("line").rlike(_HEADER)
    marked = lines.withColumn("mark", F.when(head, F.col("pos")).when(F.col("line").startswith("##"), F.lit(-1)))
    w = Window.partitionBy(row_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = marked.withColumn("block", F.last("mark", ignorenulls=True).over(w)).where("block >= 0")
    opening = F.when(head, F.col("line"))
    step = F.when(F.col("line").startswith("**Next:**"), F.trim(F.substring("line", 10, 10_000_000)))
    g = blocks.groupBy(row_id, "block").agg(F.max(opening).alias("h"), F.min(F.when(step.isNotNull(), F.struct("pos", step.alias("step")))).alias("n"))
    part = lambda k: F.nullif(F.regexp_extract("h", _HEADER, k), F.lit(""))
    return g.select(row_id, "block", part(1).alias("day"), part(2).alias("time"), part(3).alias("channel"), part(4).alias("direction"), F.col("n.step").alias("next"))
