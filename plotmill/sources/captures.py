"""Captured result pages as JSON: compact (positional arrays) and verbose (objects) forms, to listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a compact card: address or id, price, size, rooms, title, place.
COMPACT = ("url", "price", "m2", "rooms", "title", "location")
_PAGE = "struct<c:int,count:int,n:boolean,hasNextPage:boolean,total:int,empty:boolean,p:string,L:array<array<string>>,listings:array<struct<url:string,price:double,m2:double,rooms:double,title:string,location:string>>>"


def parse_page(body: Column) -> Column:
    """The page as a struct; null for text that is no JSON object or array. A bare array is a list of cards."""
    text = F.trim(body)
    wrapped = F.when(text.startswith("[["), F.concat(F.lit('{"L":'), text, F.lit("}"))).when(text.startswith("["), F.concat(F.lit('{"listings":'), text, F.lit("}"))).otherwise(text)
    return F.from_json(wrapped, _PAGE)


def listings(pages: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """``keep`` columns, ``pos`` and the listing's six fields, of all cards of all pages.

    An id that is no address is joined to the page's prefix ``p``. Cells that are no numbers, 0 and empty texts are null.
    Pages that can't be read, or have no cards, give no rows; null bodies likewise.
    """
    page = pages.select(*keep, parse_page(F.col(body)).alias("page"))
    as_text = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    rows = page.select(*keep, F.col("page.p").alias("p"), F.posexplode(F.coalesce("page.L", F.array().cast("array<array<string>>"))).alias("pos", "x"))
    cell = {name: F.get("x", F.lit(k)) for k, name in enumerate(COMPACT)}
    url = F.when(cell["url"].rlike("^https?://"), cell["url"]).otherwise(F.concat(F.coalesce("p", F.lit("")), cell["url"]))
    compact = rows.select(*keep, "pos", url.alias("url"), *[number(cell[c]).alias(c) for c in ("price", "m2", "rooms")], as_text(cell["title"]).alias("title"), as_text(cell["location"]).alias("location"))
    verbose = page.select(*keep, F.posexplode("page.listings").alias("pos", "x")).select(*keep, "pos", "x.url", *[F.nullif(F.col(f"x.{c}"), F.lit(0.0)).alias(c) for c in ("price", "m2", "rooms")], as_text(F.col("x.title")).alias("title"), as_text(F.col("x.location")).alias("location"))
    return compact.unionByName(verbose)


def page_state(pages: DataFrame, keep: list[str], page_no: str, body: str = "body") -> DataFrame:
    """Cards found per page, and whether a page without cards is a true end (``empty``), a format drift or an error."""
    p = pages.select(*keep, page_no, F.when(F.get_json_object(body, "$").isNotNull(), parse_page(F.col(body))).alias("page"))
    size = F.coalesce("page.c", "page.count", F.size(F.coalesce("page.L", F.array().cast("array<array<string>>"))) + F.coalesce(F.size("page.listings"), F.lit(0)))
    state = (
        F.when(F.col("page").isNull(), "unreadable").when(size > 0, "ok").when(F.coalesce("page.empty", F.lit(False)) | (F.col("page.total") == 0), "empty").when(F.col(page_no) == 1, "drift").otherwise("end")
    )
    return p.select(*keep, page_no, size.alias("cards"), F.coalesce("page.n", "page.hasNextPage", F.lit(False)).alias("more"), state.alias("state"))


#: Texts of walls against robots, in the title or in the first 4000 visible characters, and marks of embedded
#: challenges in the markup.
WALL_TEXTS, WALL_CHARS, WALL_MARKS = ("Ich bin kein Roboter", "captcha", "Are you a robot"), 4000, ("captcha-delivery.com",)


def is_blocked(title: Column, visible: Column, html: Column) -> Column:
    """Whether a page is a wall: by its title, the beginning of its visible text, or a mark in its markup; scripts that
    only name such words don't count. Null parts show nothing."""
    has = lambda c, words: F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)), F.lit(False))
    return has(title, WALL_TEXTS) | has(F.substring(visible, 1, WALL_CHARS), WALL_TEXTS) | has(html, WALL_MARKS)
