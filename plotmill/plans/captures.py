"""Queries of sources and sinks: rows are rendered in each form and read back by the reader of that form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.runtime import new_path, read_table
from plotmill.sources import captures, cards, files, mail, markdown


def _pages(spark: SparkSession, sf: str, compact: bool) -> DataFrame:
    """Inbox rows as captured pages of one batch and portal."""
    i = read_table(spark, sf, "scan_inbox").withColumn("page_no", F.pmod("entry_id", F.lit(40)) + 1)
    if compact:
        cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        card = F.array(*map(cell, ("url", "price", "m2", "rooms", "title", "location")))
    else:
        card = F.struct("url", "price", "m2", "rooms", "title", "location")
    name = "L" if compact else "listings"
    page = F.struct(F.count(F.lit(1)).cast("int").alias("c"), F.lit(True).alias("n"), F.sort_array(F.collect_list(F.struct("entry_id", card.alias("card")))).getField("card").alias(name))
    return i.groupBy("batch_no", "page_no").agg(F.to_json(page).alias("body"))


def json_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows through compact pages of positional arrays."""
    return captures.listings(_pages(spark, sf, True), ["batch_no", "page_no"]).drop("pos")


def json_verbose(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows through verbose pages of objects."""
    return captures.listings(_pages(spark, sf, False), ["batch_no", "page_no"]).drop("pos")


CAPTURE_SQL = "SELECT batch_no, entry_id % 40 + 1 AS page_no, url, nullif(price, 0) AS price, nullif(m2, 0) AS m2, nullif(rooms, 0) AS rooms, nullif(trim(title), '') AS title, nullif(trim(location), '') AS location FROM scan_inbox"


def markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker rows through a Markdown table."""
    a = read_table(spark, sf, "tracker_additions")
    cols = ["num", "add_date", "portal", "offer_type", "location", "price", "m2", "rooms", "score", "status", "report", "notes"]
    lines = a.select("addition_id", markdown.table_line([F.col(c) for c in cols]).alias("line"))
    rows = markdown.table_rows(lines, ["addition_id"], markdown.TRACKER, least=10)
    return rows.select("addition_id", "num", F.col("date").try_cast("date").alias("add_date"), "portal", "location", F.col("price").try_cast("double").alias("price"), "status", "notes")


MARKDOWN_SQL = """SELECT addition_id, num, add_date, trim(replace(coalesce(portal, ''), '|', '/')) AS portal, nullif(trim(translate(coalesce(location, ''), '|' || chr(10), '/ ')), '-') AS location, price, trim(coalesce(status, '')) AS status,
nullif(trim(translate(coalesce(notes, ''), '|' || chr(10), '/ ')), '-') AS notes FROM tracker_additions WHERE regexp_full_match(num, '[0-9]+')"""


def queue_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All history rows through queue lines, titles as they are: rooms missing in the line come from the title."""
    h = read_table(spark, sf, "scan_history")
    line = markdown.queue_line(F.col("url"), F.col("portal"), F.lit("g"), F.col("title"), F.col("price"), F.col("m2"), F.col("rooms"), F.col("location"))
    return markdown.queue_rows(h.select("entry_id", line.alias("line")), ["entry_id"]).select("entry_id", "url", "source", "title", F.round("m2", 2).alias("m2"), "rooms", "location")


# the reader ignores case for ASCII letters only
QUEUE_SQL = """WITH h AS (SELECT entry_id, url, portal, m2, rooms, location, trim(regexp_replace(replace(coalesce(title, ''), '|', '/'), '\\s+', ' ', 'g')) AS title FROM scan_history WHERE url IS NOT NULL),
t AS (SELECT *, regexp_extract(title, '([0-9]+(?:[.,][0-9]+)?)[\\s-]*(?:[Zz][Ii]|[Rr][Aa][Uu][Mm]|[Rr]ä[Uu][Mm][Ee])', 1) AS said FROM h)
SELECT entry_id, regexp_extract(url, 'https?://[^\\s|]+') AS url, coalesce(portal, '') AS source, title, coalesce(m2, 0) AS m2,
CASE WHEN rooms > 0 THEN rooms ELSE coalesce(try_cast(replace(regexp_replace(said, '^([0-9]+)[.]([0-9]{3})$', '\\1\\2'), ',', '.') AS double), 0) END AS rooms,
lower(trim(regexp_replace(replace(coalesce(location, ''), '|', '/'), '\\s+', ' ', 'g'))) AS location FROM t"""


def correspondence_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the correspondence logs, per channel and direction, with those that name a next step."""
    d = read_table(spark, sf, "documents").where(F.lower(F.trim("source")) == "correspondence")
    return markdown.correspondence(d, "doc_id").groupBy("channel", "direction").agg(F.count(F.lit(1)).alias("blocks"), F.count("next").alias("steps"), F.min("day").alias("first_day"))


def history_files(spark: SparkSession, sf: str) -> DataFrame:
    """History rows appended to tab-separated files and read back."""
    path = new_path(spark, "history-tsv")
    files.append_history(read_table(spark, sf, "scan_history").where("url is not null"), path)
    return files.read_history(spark, path).groupBy("portal", "first_seen").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.round(F.sum("m2"), 2).alias("m2"))


FILES_SQL = "SELECT portal, first_seen, count(*) AS n, count(nullif(price, 0)) AS priced, round(sum(nullif(m2, 0)), 2) AS m2 FROM scan_history WHERE url IS NOT NULL GROUP BY 1, 2"


def archive_files(spark: SparkSession, sf: str) -> DataFrame:
    """Closed history rows appended to the monthly archive, and one month read with the others pruned."""
    path = new_path(spark, "archive")
    files.append_archive(read_table(spark, sf, "scan_history").where("status <> 'added'"), path)
    return spark.read.parquet(path).where("month = '2026-05'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


ARCHIVE_SQL = "SELECT status, count(*) AS n FROM scan_history WHERE status <> 'added' AND strftime(first_seen, '%Y-%m') = '2026-05' GROUP BY 1"


def mail_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Notes sent as attachments, decoded from URL-safe base64 in JSON."""
    head = F.lit('From: a@x.example\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: application/octet-stream; name="n.bin"\r\nContent-Disposition: attachment; filename="n.bin"\r\nContent-Transfer-Encoding: base64\r\n\r\n')
    note = F.coalesce("notes", F.lit(""))
    message = F.concat(head, F.base64(F.encode(note, "UTF-8")), F.lit("\r\n--b--\r\n"))
    raw = F.translate(F.base64(F.encode(message, "UTF-8")), "+/", "-_")
    a = read_table(spark, sf, "tracker_additions").select("addition_id", F.to_json(F.struct(F.struct(raw.alias("raw")).alias("message"))).alias("body"))
    return mail.attachments(a, "addition_id").select(F.col("row_id").alias("addition_id"), "name", F.decode("content", "UTF-8").alias("notes"))


MAIL_SQL = "SELECT addition_id, 'n.bin' AS name, coalesce(notes, '') AS notes FROM tracker_additions"

def html_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows through result pages in HTML, read by the general card rule."""
    i = read_table(spark, sf, "scan_inbox").withColumn("page_no", F.pmod("entry_id", F.lit(40)) + 1)
    fact = lambda c, kind, unit: F.when(F.col(c) > 0, F.concat(F.lit("<p>"), F.replace(F.col(c).cast(kind).cast("string"), F.lit("."), F.lit(",")), F.lit(f" {unit}</p>")))
    card = F.concat_ws("", F.lit('<div class="listing-card"><a href="/x/'), "entry_id", F.lit('">w</a><h3>Nr. '), "entry_id", F.lit("</h3>"), fact("price", "decimal(12,2)", "€"), fact("m2", "decimal(12,2)", "m²"), fact("rooms", "int", "Zi"), F.lit("</div>"))
    pages = i.groupBy("batch_no", "page_no").agg(F.array_join(F.collect_list(card), "\n").alias("html")).select((F.col("batch_no") * 100 + F.col("page_no")).cast("bigint").alias("page_id"), F.lit("other").alias("source"), F.lit("https://p.example/").alias("url"), "html")
    return cards.card_listings(pages, "page_id", "source", "url", "html").drop("pos", "location", "source")


HTML_SQL = """SELECT CAST(batch_no * 100 + entry_id % 40 + 1 AS bigint) AS page_id, 'https://p.example/x/' || entry_id AS url, 'Nr. ' || entry_id AS title, CASE WHEN price > 0 THEN CAST(CAST(price AS decimal(12,2)) AS double) END AS price, CASE WHEN m2 > 0 THEN CAST(CAST(m2 AS decimal(12,2)) AS double) END AS m2,
CASE WHEN rooms > 0 THEN CAST(trunc(rooms) AS double) END AS rooms FROM scan_inbox WHERE price > 0 OR m2 > 0"""

QUERIES = {f.__name__: f for f in (html_cards, json_compact, json_verbose, markdown_table, queue_lines, correspondence_blocks, history_files, archive_files, mail_attachments)}
ORACLES = {"html_cards": HTML_SQL, "json_compact": CAPTURE_SQL, "json_verbose": CAPTURE_SQL, "markdown_table": MARKDOWN_SQL, "queue_lines": QUEUE_SQL, "history_files": FILES_SQL, "archive_files": ARCHIVE_SQL, "mail_attachments": MAIL_SQL}
