"""Queries of housekeeping: section hygiene, retention that moves rows, settings joined to what they are about, page
states, failure classes, tracker and viewing joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.functions import dates, text
from plotmill.operators import housekeeping as keep
from plotmill.runtime import read_table
from plotmill.sources import captures, settings

#: Messages of failed page loads, with their classes.
FAILURES = [
    ("HTTP 403", "bot_defense"), ("403 Forbidden", "bot_defense"), ("net::ERR_CONNECTION_RESET", "bot_defense"), ("request was blocked", "bot_defense"), ("ERR_HTTP2_PROTOCOL_ERROR", "bot_defense"), ("Access Denied", "bot_defense"),
    ("Timeout 45000ms exceeded", "transient"), ("operation timed out", "transient"), ("Navigation failed", "transient"), ("HTTP 429", "error"), ("captcha", "error"), ("socket reset", "error"), ("selector not found", "error"),
]


def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows with a failure message each, by portal and class."""
    messages = F.array(*[F.lit(m) for m, _ in FAILURES])
    i = read_table(spark, sf, "scan_inbox").select("portal", F.get(messages, F.pmod("entry_id", F.lit(len(FAILURES))).cast("int")).alias("message"))
    return i.groupBy("portal", text.error_class(F.col("message")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


CLASSES_SQL = f"""SELECT portal, class, count(*) AS n FROM scan_inbox JOIN (VALUES {", ".join(f"({k}, '{c}')" for k, (_, c) in enumerate(FAILURES))}) v(k, class) ON entry_id % {len(FAILURES)} = k GROUP BY 1, 2"""


def page_states(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in each of the states, by what they hold: cards, an explicit empty result, nothing on the first or on a later
    page, no JSON."""
    i = read_table(spark, sf, "scan_inbox").select("entry_id", (F.pmod("entry_id", F.lit(3)) + 1).cast("int").alias("page_no"), F.pmod("entry_id", F.lit(7)).alias("k"))
    card = F.concat(F.lit('{"c":1,"n":true,"L":[["/x/'), "entry_id", F.lit('","500"]]}'))
    body = F.when(F.col("k") == 0, "<html>not found</html>").when(F.col("k") == 1, '{"listings":[],"empty":true}').when(F.col("k") == 2, '{"c":0,"L":[]}').when(F.col("k") == 3, '{"total":0,"L":[]}').when(F.col("k") == 4, F.lit(None)).when(F.col("k") == 5, F.concat(F.lit('[{"url":"/y/'), "entry_id", F.lit('"}]'))).otherwise(card)
    states = captures.page_state(i.select("page_no", "entry_id", body.alias("body")), ["entry_id"], "page_no")
    return states.groupBy("page_no", "state", "more").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("cards", F.lit(0))).cast("bigint").alias("cards"))


STATES_SQL = """WITH p AS (SELECT entry_id % 3 + 1 AS page_no, entry_id % 7 AS k FROM scan_inbox)
SELECT page_no, CASE WHEN k IN (0, 4) THEN 'unreadable' WHEN k IN (1, 3) THEN 'empty' WHEN k = 2 THEN CASE WHEN page_no = 1 THEN 'drift' ELSE 'end' END ELSE 'ok' END AS state, k = 6 AS more, count(*) AS pages, CAST(count(*) FILTER (WHERE k > 4) AS bigint) AS cards FROM p GROUP BY ALL"""


def blocked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are a wall against robots, by visible text or by the markup of an embedded challenge."""
    d = read_table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.pmod("doc_id", F.lit(5)).alias("k"))
    title = F.when(F.col("k") == 1, "Are you a robot?").otherwise("Angebote")
    body = F.when(F.col("k") == 2, F.concat(F.lit("Ich bin kein Roboter "), "text")).when(F.col("k") == 3, F.concat(F.repeat(F.lit("x"), F.lit(4000)), F.lit("Ich bin kein Roboter"))).otherwise(F.regexp_replace("text", "captcha|Are you a robot|Ich bin kein Roboter", ""))
    html = F.when(F.col("k") == 4, '<iframe src="https://geo.captcha-delivery.com/x">').otherwise('<script src="recaptcha.js">')
    return d.select("doc_id", captures.is_blocked(title, body, html).alias("blocked")).where("blocked").select("doc_id")


BLOCKED_SQL = "SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 5 IN (1, 2, 4)"


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    """History rows as lines of a queue file per portal; some stand in the wrong section."""
    h = read_table(spark, sf, "scan_history").where("portal is not null and status is not null")
    section = F.when(F.pmod("entry_id", F.lit(11)) == 0, "Notes").when((F.col("status") == "added") != (F.pmod("entry_id", F.lit(5)) == 0), "Pending").otherwise("Processed")
    mark = F.when(F.col("status") == "added", "- [ ] ").otherwise("- [x] ")
    return h.select(F.col("portal").alias("file"), "entry_id", section.alias("section"), F.concat(mark, "entry_id").alias("line"), F.col("status").alias("status"))


def section_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Queue lines after section hygiene, counted by where they stood and where they go."""
    moved = keep.section_hygiene(_queue(spark, sf), "section", "line")
    return moved.groupBy("file", F.col("section").alias("was"), "goes").agg(F.count(F.lit(1)).alias("n"))


_QUEUE_CTE = """q AS (SELECT portal AS file, entry_id, CASE WHEN entry_id % 11 = 0 THEN 'Notes' WHEN (status = 'added') <> (entry_id % 5 = 0) THEN 'Pending' ELSE 'Processed' END AS section, status FROM scan_history WHERE portal IS NOT NULL AND status IS NOT NULL)"""
MOVES_SQL = f"WITH {_QUEUE_CTE} SELECT file, section AS was, CASE WHEN section = 'Notes' THEN 'Notes' WHEN status = 'added' THEN 'Pending' ELSE 'Processed' END AS goes, count(*) AS n FROM q GROUP BY ALL"


def section_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines pending, processed, and done but still under pending, per file."""
    return keep.section_counts(_queue(spark, sf), "file", "section", "line")


COUNTS_SQL = f"WITH {_QUEUE_CTE} SELECT file, count(*) FILTER (WHERE section = 'Pending') AS pending, count(*) FILTER (WHERE section = 'Processed') AS processed, count(*) FILTER (WHERE section = 'Pending' AND status <> 'added') AS done_pending FROM q GROUP BY 1"


def retention_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Done inbox rows as of October: archived when older than 30 days, dated by the history where it knows the address,
    dated today and kept where it doesn't."""
    i = read_table(spark, sf, "scan_inbox").where("status <> 'added'").select("entry_id", "url")
    split = keep.retain(i, read_table(spark, sf, "scan_history"), "url", F.lit("2026-10-01").cast("date"), 30)
    return split.select("entry_id", "goes", F.date_format("since", "yyyy-MM-dd").alias("since"))


RETAIN_SQL = """WITH h AS (SELECT url, min(first_seen) AS since FROM scan_history WHERE url IS NOT NULL GROUP BY 1)
SELECT entry_id, CASE WHEN since IS NULL THEN 'backfill' WHEN DATE '2026-10-01' - since > 30 THEN 'archive' ELSE 'keep' END AS goes, strftime(coalesce(since, DATE '2026-10-01'), '%Y-%m-%d') AS since FROM scan_inbox LEFT JOIN h USING (url) WHERE status <> 'added'"""


def compaction_rows(spark: SparkSession, sf: str) -> DataFrame:
    """History rows that compaction moves to the archive of their month: rejected ones, more than 90 days old."""
    moved, _ = keep.compact(read_table(spark, sf, "scan_history"), F.col("status") == "skipped_criteria", "first_seen", F.lit("2026-10-01").cast("date"), 90)
    return moved.select("entry_id", "month")


COMPACT_SQL = "SELECT entry_id, strftime(first_seen, '%Y-%m') AS month FROM scan_history WHERE status = 'skipped_criteria' AND DATE '2026-10-01' - first_seen > 90"

#: A settings file in the form that the searches have.
SETTINGS = """
searches:
  - name: Kauf Nord
    portal: Wohnkompass
    url: "https://www.wohnkompass.example/s?o=kauf"   # bought
    risk: high
  - name: Miete
    portal: Wohnkompass
    enabled: false
    url: https://www.wohnkompass.example/s?o=miete
  - name: Miete
    portal: Mietradar
    url: 'https://mietradar.example/s'
    areas: [Hagenmitte, "Waldau"]
  - name: Zweite
    portal: Mietradar
    risk: high
    url: https://mietradar.example/zweite
  - name: Alle
    portal: Kiezmarkt
    enabled: true
groups:
  - label: Nord
    search: Kauf Nord
  - label: Mitte
    search: Fehlt
"""

_SEARCHES = [("Kauf Nord", "Wohnkompass", "https://www.wohnkompass.example/s?o=kauf", True, "high", 0), ("Miete", "Wohnkompass", "https://www.wohnkompass.example/s?o=miete", False, None, 1), ("Miete", "Mietradar", "https://mietradar.example/s", True, None, 2), ("Zweite", "Mietradar", "https://mietradar.example/zweite", True, "high", 3), ("Alle", "Kiezmarkt", None, True, None, 4)]
_SEARCH_SQL = "s(name, portal, url, enabled, risk, pos) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _SEARCHES) + ")"


def search_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The search of each tracker row's portal: the one named like its offer type, else the portal's first enabled one."""
    s = settings.searches(spark, settings.parse_settings(SETTINGS))
    a = read_table(spark, sf, "tracker_additions").select("addition_id", "portal", F.initcap(F.trim("offer_type")).alias("name"))
    return settings.search_for(a, s, "portal", "name").select("addition_id", "search", "url")


SEARCH_OF_SQL = f"""WITH {_SEARCH_SQL}, a AS (SELECT addition_id, portal, trim(offer_type, ' ') AS t FROM tracker_additions), n AS (SELECT addition_id, portal, upper(left(t, 1)) || lower(substr(t, 2)) AS name FROM a),
e AS (SELECT portal, name, url FROM s WHERE enabled), f AS (SELECT portal, arg_min(name, pos) AS name, first(url ORDER BY pos) AS url FROM s WHERE enabled GROUP BY 1)
SELECT addition_id, coalesce(e.name, f.name) AS search, CASE WHEN e.name IS NOT NULL THEN e.url ELSE f.url END AS url FROM n LEFT JOIN e ON n.portal = e.portal AND n.name = e.name LEFT JOIN f ON n.portal = f.portal"""


def search_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Enabled searches, those of high risk last, with the groups that name them and the history rows of their portal."""
    parsed = settings.parse_settings(SETTINGS)
    s = settings.ordered(settings.searches(spark, parsed).where("enabled"))
    g = settings.groups(spark, parsed)
    counts = read_table(spark, sf, "scan_history").groupBy("portal").agg(F.count(F.lit(1)).alias("n_rows"))
    return s.join(F.broadcast(g), F.col("name") == F.col("search"), "left").join(counts, "portal", "left").select("rank", "name", "portal", "label", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


LISTING_SQL = f"""WITH {_SEARCH_SQL}, g(label, search) AS (VALUES ('Nord', 'Kauf Nord'), ('Mitte', 'Fehlt')), c AS (SELECT portal, count(*) AS n_rows FROM scan_history GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY coalesce(risk = 'high', false), pos) AS int) AS rank, name, portal, label, coalesce(n_rows, 0) AS n_rows FROM s LEFT JOIN g ON name = search LEFT JOIN c USING (portal) WHERE enabled"""


def excluded_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows in an area that the settings name, by part of the place and whatever the case."""
    areas = settings.parse_settings(SETTINGS)["searches"][2]["areas"]
    return read_table(spark, sf, "scan_inbox").where(settings.in_areas(F.col("location"), areas)).select("entry_id")


AREAS_SQL = "SELECT entry_id FROM scan_inbox WHERE contains(lower(location), 'hagenmitte') OR contains(lower(location), 'waldau')"


def tracker_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker rows with the flags decided and skipped; the decided ones only are ``decided_rows``."""
    return keep.with_flags(read_table(spark, sf, "tracker_additions"), "status", DECIDED, SKIPPED).select("addition_id", "decided", "skipped")


#: Statuses of the flags, as parameters of the operator.
DECIDED, SKIPPED = ("Viewed", "Rejected", "Applied"), ("Rejected", "Discarded")
FLAGS_SQL = f"SELECT addition_id, coalesce(lower(trim(status)) IN ({', '.join(repr(s.lower()) for s in DECIDED)}), false) AS decided, coalesce(lower(trim(status)) IN ({', '.join(repr(s.lower()) for s in SKIPPED)}), false) AS skipped FROM tracker_additions"


def decided_rows(spark: SparkSession, sf: str) -> DataFrame:
    return keep.with_flags(read_table(spark, sf, "tracker_additions"), "status", DECIDED, SKIPPED).where("decided").select("addition_id", "num", "status")


DECIDED_SQL = f"SELECT addition_id, num, status FROM tracker_additions WHERE lower(trim(status)) IN ({', '.join(repr(s.lower()) for s in DECIDED)})"


def viewings(spark: SparkSession, sf: str) -> DataFrame:
    """Viewings (tracker rows so marked) joined to reports as their documents, by path: the viewing's moment, without a
    time the end of the day, and the number and first of its documents. Rows without a valid date or number are left out."""
    v = read_table(spark, sf, "tracker_additions").where("status = 'Viewing'").select("addition_id", "num", F.col("add_date").cast("string").alias("date"), F.regexp_extract("notes", "([0-9]{1,2}:[0-9]{2})", 1).alias("time"), F.nullif(F.regexp_extract(F.coalesce("report", F.lit("")), "reports/.*?\\.md", 0), F.lit("")).alias("path"))
    valid = v.where(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z") & F.col("num").rlike("^[0-9]+\\z"))
    d = read_table(spark, sf, "reports").groupBy("path").agg(F.count(F.lit(1)).alias("n_documents"), F.min("report_id").alias("first_document"))
    return valid.join(d, "path", "left").select("addition_id", F.date_format(dates.moment(F.col("date"), F.col("time")), "yyyy-MM-dd HH:mm").alias("at"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "first_document")


VIEWINGS_SQL = """WITH v AS (SELECT addition_id, add_date, regexp_extract(coalesce(notes, ''), '([0-9]{1,2}:[0-9]{2})', 1) AS t, nullif(regexp_extract(coalesce(report, ''), 'reports/.*?\\.md'), '') AS path FROM tracker_additions WHERE status = 'Viewing' AND add_date IS NOT NULL AND regexp_full_match(num, '[0-9]+')),
d AS (SELECT path, count(*) AS n, min(report_id) AS first_document FROM reports GROUP BY 1)
SELECT addition_id, strftime(coalesce(try_strptime(strftime(add_date, '%Y-%m-%d') || ' ' || t, '%Y-%m-%d %H:%M'), add_date + INTERVAL '23 hours 59 minutes'), '%Y-%m-%d %H:%M') AS at, coalesce(n, 0) AS n_documents, first_document FROM v LEFT JOIN d USING (path)"""


def available_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Date texts in several forms, rendered from the history, read back: at once, German, ISO, else none."""
    h = read_table(spark, sf, "scan_history").select("entry_id", "first_seen", F.pmod("entry_id", F.lit(5)).alias("k"))
    written: Column = F.when(F.col("k") == 0, "ab sofort").when(F.col("k") == 1, F.date_format("first_seen", "d.M.yyyy")).when(F.col("k") == 2, F.concat(F.lit("ab "), F.date_format("first_seen", "dd.MM.yyyy"))).when(F.col("k") == 3, F.date_format("first_seen", "yyyy-MM-dd")).otherwise("nach Vereinbarung")
    return h.select("entry_id", dates.available_date(written, F.lit("2026-11-01").cast("date")).alias("available"))


AVAILABLE_SQL = "SELECT entry_id, CASE entry_id % 5 WHEN 0 THEN DATE '2026-11-01' WHEN 4 THEN NULL ELSE first_seen END AS available FROM scan_history"


def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object per batch, with counts and the status of its coverage: 0 all portals gave rows, 1 some didn't, 2
    none did, 3 no row at all."""
    i = read_table(spark, sf, "scan_inbox")
    per = i.groupBy("batch_no", "portal").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("status") == "added").alias("added"))
    total = per.groupBy("batch_no").agg(F.sum("found").alias("found"), F.sum("added").alias("added"), keep.coverage(F.col("added") > 0).alias("coverage"))
    return total.select("batch_no", F.to_json(F.struct("found", "added", "coverage")).alias("report"))


BATCH_SQL = """WITH p AS (SELECT batch_no, portal, count(*) AS found, count(*) FILTER (WHERE status = 'added') AS added FROM scan_inbox GROUP BY 1, 2)
SELECT batch_no, '{"found":' || sum(found) || ',"added":' || sum(added) || ',"coverage":' || CASE WHEN count(*) FILTER (WHERE added > 0) = count(*) THEN 0 WHEN count(*) FILTER (WHERE added > 0) > 0 THEN 1 ELSE 2 END || '}' AS report FROM p GROUP BY 1"""

_ALL = {
    error_classes: CLASSES_SQL, page_states: STATES_SQL, blocked_pages: BLOCKED_SQL, section_moves: MOVES_SQL, section_counts: COUNTS_SQL, retention_rows: RETAIN_SQL, compaction_rows: COMPACT_SQL, search_of_rows: SEARCH_OF_SQL, search_listing: LISTING_SQL, excluded_areas: AREAS_SQL,
    tracker_flags: FLAGS_SQL, decided_rows: DECIDED_SQL, viewings: VIEWINGS_SQL, available_dates: AVAILABLE_SQL, batch_report: BATCH_SQL,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL.items()}
