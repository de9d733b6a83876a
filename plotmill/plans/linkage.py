"""Queries of record linkage and incremental ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.functions import text
from plotmill.functions.places import neighbourhood
from plotmill.operators import incremental, linkage
from plotmill.operators.bands import Band, band_join  # noqa: F401
from plotmill.runtime import read_table


#: Town names go into expressions; a longer list is refused.
MAX_TOWNS = 100_000


def town_names(spark: SparkSession, sf: str) -> list[str]:
    names = read_table(spark, sf, "gazetteer").select(F.lower(F.regexp_replace("town", " (an der|am) .*", ""))).distinct().limit(MAX_TOWNS + 1).collect()
    if len(names) > MAX_TOWNS:
        raise ValueError(f"more than {MAX_TOWNS} towns")
    return sorted(r[0] for r in names if r[0])


def _hooded(df: DataFrame, towns: list[str]) -> DataFrame:
    return df.withColumn("hood", neighbourhood(F.col("location"), towns))


_TOWNS_SQL = "t AS (SELECT list(DISTINCT lower(regexp_replace(town, ' (an der|am) .*', ''))) AS towns FROM gazetteer)"
_HOOD_SQL = "coalesce(list_filter(list_transform(string_split(lower(coalesce(location, '')), ','), lambda f: trim(regexp_replace(regexp_replace(regexp_replace(f, '\\b[0-9]{4,5}\\b', ' ', 'g'), '[^a-zäöüß ]+', ' ', 'g'), ' +', ' ', 'g'))), lambda f: f <> '' AND NOT list_contains(towns, f))[-1], '')"
_DISC = "'i{1,3}|iv|v|nord|n[öo]rdliche|süd|sued|s[üu]dliche|ost|[öo]stliche|west|westliche|mitte'"


def _agree_sql(a: str, b: str) -> str:
    ta, tb = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    ma, mb = f"list_filter({ta}, lambda t: NOT list_contains({tb}, t))", f"list_filter({tb}, lambda t: NOT list_contains({ta}, t))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN NULL WHEN {a} = {b} THEN true WHEN len({ma}) = len({ta}) OR len(list_filter(list_concat({ma}, {mb}), lambda t: regexp_full_match(t, {_DISC}))) > 0 THEN false WHEN len({ma}) = 0 OR len({mb}) = 0 THEN true END"


def cross_source_links(spark: SparkSession, sf: str) -> DataFrame:
    """Per inbox row, how many rows of its batch show the same object on another portal."""
    rows = _hooded(read_table(spark, sf, "scan_inbox"), town_names(spark, sf)).select("entry_id", "batch_no", "url", "portal", "price", "m2", "rooms", "hood")
    pairs = linkage.cross_source_pairs(rows, "entry_id", ["batch_no"])
    both = pairs.select(F.explode(F.array("id_a", "id_b")).alias("entry_id"), "kind")
    return both.groupBy("entry_id").agg(F.count_if(F.col("kind") == "confirmed").alias("n_confirmed"), F.count_if(F.col("kind") == "numeric").alias("n_numeric"))


CROSS_SQL = f"""WITH {_TOWNS_SQL}, r AS (SELECT entry_id, batch_no, url, portal, price, m2, rooms, {_HOOD_SQL} AS hood FROM scan_inbox, t WHERE price > 0 AND m2 > 0),
near AS (SELECT a.entry_id AS ia, b.entry_id AS ib, a.hood AS ha, b.hood AS hb, a.rooms AS ra, b.rooms AS rb FROM r a JOIN r b ON a.batch_no = b.batch_no AND a.entry_id < b.entry_id AND a.url IS DISTINCT FROM b.url AND a.portal IS DISTINCT FROM b.portal
 AND abs(a.price - b.price) / greatest(a.price, b.price) < 0.05 AND abs(a.m2 - b.m2) <= 3),
p AS (SELECT ia, ib, CASE WHEN ({_agree_sql("ha", "hb")}) THEN 'confirmed' WHEN ({_agree_sql("ha", "hb")}) IS NULL AND ra > 0 AND ra = rb THEN 'numeric' END AS kind FROM near)
SELECT entry_id, count(*) FILTER (WHERE kind = 'confirmed') AS n_confirmed, count(*) FILTER (WHERE kind = 'numeric') AS n_numeric FROM (SELECT ia AS entry_id, kind FROM p UNION ALL SELECT ib, kind FROM p) WHERE kind IS NOT NULL GROUP BY 1"""


def best_match(spark: SparkSession, sf: str) -> DataFrame:
    """For every fiftieth inbox row the best row of the whole tracker by numbers and place; with unit codes and titles it is
    ``best_match_known``."""
    towns = town_names(spark, sf)
    cols = ["price", "m2", "rooms", "hood"]
    queries = _hooded(read_table(spark, sf, "scan_inbox").where("entry_id % 50 = 0"), towns).select("entry_id", *cols)
    pool = _hooded(read_table(spark, sf, "tracker_additions"), towns).select("addition_id", *cols)
    return linkage.best_match(queries, "entry_id", pool, "addition_id").select(F.col("candidate").alias("entry_id"), F.col("match").alias("addition_id"), "kind", F.round("gap", 6).alias("gap"))


BEST_SQL = f"""WITH {_TOWNS_SQL}, c AS (SELECT entry_id, price, m2, rooms, {_HOOD_SQL} AS hood FROM scan_inbox, t WHERE entry_id % 50 = 0 AND price > 0 AND m2 > 0),
e AS (SELECT addition_id, price, m2, rooms, {_HOOD_SQL} AS hood FROM tracker_additions, t WHERE price > 0 AND m2 > 0),
near AS (SELECT entry_id, addition_id, e.hood AS ha, c.hood AS hb, e.rooms AS ra, c.rooms AS rb, abs(e.price - c.price) / greatest(e.price, c.price, 1.0) / 0.05 + abs(e.m2 - c.m2) / 3 AS gap FROM c JOIN e ON abs(e.price - c.price) / greatest(e.price, c.price) < 0.05 AND abs(e.m2 - c.m2) <= 3),
p AS (SELECT *, CASE WHEN ({_agree_sql("ha", "hb")}) THEN 'confirmed' WHEN ({_agree_sql("ha", "hb")}) IS NULL AND ra > 0 AND ra = rb THEN 'numeric' END AS kind FROM near)
SELECT entry_id, addition_id, kind, round(gap, 6) AS gap FROM p WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY kind, gap, addition_id) = 1"""


def best_match_known(spark: SparkSession, sf: str) -> DataFrame:
    """As ``best_match``, with unit codes and titles; a tracker row's titles are those that the history has at its report's
    address, the first of them is the report's."""
    towns = town_names(spark, sf)
    title = F.col("title")
    inbox = _hooded(read_table(spark, sf, "scan_inbox").where("entry_id % 50 = 0"), towns)
    queries = inbox.select("entry_id", "price", "m2", "rooms", "hood", text.unit_codes(title).alias("codes"), text.title_tokens(title).alias("tokens"), text.title_key(title).alias("key"))
    # titles are summed up by address before they meet its reports: a third of both may be at one address
    seen = read_table(spark, sf, "scan_history").where("url <> '' and title <> ''").groupBy("url", "title").agg(F.min("entry_id").alias("entry_id"))
    paths = read_table(spark, sf, "reports").where("url <> ''").select("path", "url").distinct()
    asked = queries.where("key <> ''").select("key").distinct()
    first = seen.groupBy("url").agg(F.min(F.struct(F.isnull("entry_id").alias("last"), "entry_id", "title")).alias("first"))
    # keys that no query has match nothing
    keys = seen.select("url", text.title_key(title).alias("key")).join(asked, "key", "left_semi").groupBy("url").agg(F.collect_set("key").alias("keys"))
    known = first.join(keys, "url", "left").join(paths, "url")
    titles = known.groupBy("path").agg(F.min("first")["title"].alias("title"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    rows = _hooded(read_table(spark, sf, "tracker_additions"), towns).withColumn("path", F.regexp_extract(F.coalesce("report", F.lit("")), "reports/.*?\\.md", 0))
    pool = rows.join(titles, "path", "left").select("addition_id", "price", "m2", "rooms", "hood", text.unit_codes(F.concat_ws(" ", "title", "notes")).alias("codes"), text.title_tokens(F.col("title")).alias("tokens"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
    return linkage.known_match(queries, "entry_id", pool, "addition_id").select(F.col("candidate").alias("entry_id"), F.col("match").alias("addition_id"), "kind", F.round("gap", 6).alias("gap"))


def footprint(spark: SparkSession, sf: str) -> DataFrame:
    """For every fiftieth inbox row, how many adverts of the history show its object."""
    towns = town_names(spark, sf)
    cols = ["url", "title", "price", "m2", "rooms", "hood", text.squash(F.col("title")).alias("squashed")]
    targets = _hooded(read_table(spark, sf, "scan_inbox").where("entry_id % 50 = 0"), towns).select("entry_id", *cols)
    pool = _hooded(read_table(spark, sf, "scan_history"), towns).select(*cols)
    return linkage.footprint(targets, "entry_id", pool).groupBy(F.col("target").alias("entry_id")).agg(F.count(F.lit(1)).alias("n_urls"), F.min("url").alias("first_url"))


_SQUASH = "regexp_replace(lower(title), '[^a-zäöüß0-9]+', '', 'g')"
FOOTPRINT_SQL = f"""WITH {_TOWNS_SQL}, c AS (SELECT entry_id, url, price, m2, rooms, {_SQUASH} AS sq, {_HOOD_SQL} AS hood FROM scan_inbox, t WHERE entry_id % 50 = 0 AND m2 > 0),
h AS (SELECT url, title, price, m2, rooms, {_SQUASH} AS sq, {_HOOD_SQL} AS hood FROM scan_history, t WHERE m2 > 0),
near AS (SELECT entry_id, h.url, c.sq = h.sq AND length(h.sq) > 8 AS titled, abs(h.price - c.price) / c.price <= 0.02 AND h.price > 0 AND c.price > 0 AS priced, h.hood AS ha, c.hood AS hb FROM c JOIN h ON abs(h.m2 - c.m2) <= 0.5 AND h.url <> c.url AND coalesce(h.rooms = c.rooms OR h.rooms <= 0 OR c.rooms <= 0, true) AND NOT coalesce(regexp_matches(title, '(?i)tausch'), false)),
p AS (SELECT *, {_agree_sql("ha", "hb")} AS agree FROM near WHERE titled OR priced)
SELECT entry_id, count(DISTINCT url) AS n_urls, min(url) AS first_url FROM p WHERE coalesce(agree, true) AND (coalesce(titled, false) OR (coalesce(priced, false) AND coalesce(agree, false))) GROUP BY 1"""


def seen_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows with an address, without query and fragment, that no earlier row has."""
    inbox = read_table(spark, sf, "scan_inbox").select("entry_id", "batch_no", "url")
    return incremental.unseen(inbox, text.canonical_url(F.col("url")), read_table(spark, sf, "scan_history"), text.canonical_url(F.col("url")), ["batch_no", "entry_id"]).select("entry_id", "url")


SEEN_SQL = """WITH k AS (SELECT entry_id, batch_no, url, split_part(split_part(url, '#', 1), '?', 1) AS c FROM scan_inbox)
SELECT entry_id, url FROM k WHERE c NOT IN (SELECT split_part(split_part(url, '#', 1), '?', 1) FROM scan_history WHERE url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY c ORDER BY batch_no, entry_id) = 1"""


def failures_carried(spark: SparkSession, sf: str) -> DataFrame:
    """Old expired rows whose portal and place weren't scanned again, with the new ones."""
    cols = ["entry_id", "portal", "location"]
    expired = lambda t: read_table(spark, sf, t).where("status = 'skipped_expired' and portal is not null and location is not null").select(*cols)
    return incremental.carry_over(expired("scan_history"), read_table(spark, sf, "scan_inbox"), expired("scan_inbox"), ["portal", "location"])


CARRY_SQL = """SELECT entry_id, portal, location FROM scan_history h WHERE status = 'skipped_expired' AND portal IS NOT NULL AND location IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scan_inbox i WHERE i.portal = h.portal AND i.location = h.location)
UNION ALL SELECT entry_id, portal, location FROM scan_inbox WHERE status = 'skipped_expired' AND portal IS NOT NULL AND location IS NOT NULL"""


def merge_staged(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker rows of the second half-year merged into those of the first."""
    rows = read_table(spark, sf, "tracker_additions").select("addition_id", "num", "report", "add_date")
    path = F.regexp_extract("report", "reports/.*?\\.md", 0)
    return incremental.merge_staged(rows.where("add_date >= '2026-07-01'"), rows.where("add_date < '2026-07-01'"), "num", path, path, "addition_id").select("addition_id", "num")


MERGE_SQL = """WITH r AS (SELECT addition_id, num, add_date, nullif(regexp_extract(report, 'reports/.*?\\.md'), '') AS path FROM tracker_additions),
old AS (SELECT * FROM r WHERE add_date < '2026-07-01'),
one AS (SELECT * FROM r WHERE add_date >= '2026-07-01' AND num IS NOT NULL AND num NOT IN (SELECT num FROM old WHERE num IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY num ORDER BY addition_id) = 1)
SELECT addition_id, num FROM one WHERE path IS NULL OR path NOT IN (SELECT path FROM old WHERE path IS NOT NULL) QUALIFY path IS NULL OR row_number() OVER (PARTITION BY path ORDER BY addition_id) = 1"""


def updates_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Reports go to the first open history row with their address, are dropped if it is only closed, else kept."""
    h = read_table(spark, sf, "scan_history").where("url is not null").groupBy("url").agg(F.min(F.when(F.col("status") == "added", F.col("entry_id"))).alias("target"))
    r = read_table(spark, sf, "reports").where("url <> ''").select("report_id", "url")
    return r.join(h.withColumn("known", F.lit(True)), "url", "left").select("report_id", F.when(F.col("target").isNotNull(), "applied").when(F.col("known"), "dropped").otherwise("kept").alias("outcome"), "target")


APPLY_SQL = """WITH h AS (SELECT url, min(entry_id) FILTER (WHERE status = 'added') AS target FROM scan_history WHERE url IS NOT NULL GROUP BY 1)
SELECT report_id, CASE WHEN target IS NOT NULL THEN 'applied' WHEN h.url IS NOT NULL THEN 'dropped' ELSE 'kept' END AS outcome, target FROM reports r LEFT JOIN h USING (url) WHERE r.url <> ''"""


def notes_appended(spark: SparkSession, sf: str) -> DataFrame:
    """The report's address appended to a row's notes, unless it is there already."""
    a = read_table(spark, sf, "tracker_additions").select("addition_id", "notes", F.nullif(F.regexp_extract("report", "reports/.*?\\.md", 0), F.lit("")).alias("path"))
    r = read_table(spark, sf, "reports").where("url <> ''").groupBy("path").agg(F.min("url").alias("url"))
    notes = F.coalesce("notes", F.lit(""))
    return a.join(r, "path", "left").select("addition_id", F.when(F.col("url").isNull() | F.contains(notes, F.col("url")), notes).otherwise(F.concat_ws("; ", F.nullif(notes, F.lit("")), "url")).alias("notes"))


NOTES_SQL = """WITH a AS (SELECT addition_id, coalesce(notes, '') AS notes, nullif(regexp_extract(report, 'reports/.*?\\.md'), '') AS path FROM tracker_additions), r AS (SELECT path, min(url) AS url FROM reports WHERE url <> '' GROUP BY 1)
SELECT addition_id, CASE WHEN url IS NULL OR contains(notes, url) THEN notes ELSE concat_ws('; ', nullif(notes, ''), url) END AS notes FROM a LEFT JOIN r USING (path)"""


def reconcile_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Differences beyond tolerance between the history and its mirror: price over 5 and 3 %, size over 1, rooms from 1."""
    from plotmill.functions.numbers import reconcile_number

    h = read_table(spark, sf, "scan_history").select("entry_id", "price", "m2", "rooms")
    m = read_table(spark, sf, "scan_mirror").select("entry_id", *[reconcile_number(F.col(c)).alias(f"{c}_m") for c in ("price", "m2", "rooms")]).distinct()

    def over(c: str, tolerance: Column, strict: bool = True) -> Column:
        gap = F.abs(F.col(c) - F.col(f"{c}_m"))
        return F.when((F.col(c) > 0) & (F.col(f"{c}_m") > 0) & (gap > tolerance if strict else gap >= tolerance), F.lit(c))

    diffs = F.array_compact(F.array(over("price", F.greatest(F.lit(5.0), F.col("price_m") * 0.03)), over("m2", F.lit(1.0)), over("rooms", F.lit(1.0), False)))
    return h.join(m, "entry_id").select("entry_id", F.array_join(diffs, ",").alias("fields")).where("fields <> ''")


def _reconcile_sql() -> str:
    from plotmill.plans.scalars import NUM_SQL

    expr = NUM_SQL.split("AS n_report,\n")[1].split(" AS n_reconcile")[0]
    cols = ", ".join(f"{expr.replace('price', c)} AS {c}_m" for c in ("price", "m2", "rooms"))
    return f"""WITH m AS (SELECT DISTINCT entry_id, {cols} FROM scan_mirror)
SELECT entry_id, concat_ws(',', CASE WHEN price > 0 AND price_m > 0 AND abs(price - price_m) > greatest(5.0, price_m * 0.03) THEN 'price' END, CASE WHEN m2 > 0 AND m2_m > 0 AND abs(m2 - m2_m) > 1 THEN 'm2' END, CASE WHEN rooms > 0 AND rooms_m > 0 AND abs(rooms - rooms_m) >= 1 THEN 'rooms' END) AS fields
FROM scan_history JOIN m USING (entry_id) WHERE fields <> ''"""


def size_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per size band; a size within 1 of a bound counts in both bands."""
    bands = spark.createDataFrame([(0, 40), (40, 60), (60, 80), (80, 100), (100, 1000)], "low int, high int")
    h = read_table(spark, sf, "scan_history").where("m2 > 0").select("m2")
    return h.join(F.broadcast(bands), (F.col("m2") >= F.col("low") - 1) & (F.col("m2") < F.col("high") + 1)).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))


BANDS_SQL = "SELECT low, high, count(*) AS n FROM scan_history JOIN (VALUES (0, 40), (40, 60), (60, 80), (80, 100), (100, 1000)) b(low, high) ON m2 > 0 AND m2 >= low - 1 AND m2 < high + 1 GROUP BY ALL"


def missing_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Plain hood names without an advert, per portal of the history."""
    h = read_table(spark, sf, "scan_history").where("portal is not null and location is not null")
    portals = h.agg(F.sort_array(F.collect_set("portal")).alias("portals"))
    wanted = read_table(spark, sf, "gazetteer").select(F.col("hood").alias("location")).join(F.broadcast(portals)).select("location", F.explode("portals").alias("portal"))
    return wanted.join(h.select("portal", "location").distinct(), ["portal", "location"], "left_anti").distinct()


MISSING_SQL = "SELECT DISTINCT hood AS location, portal FROM gazetteer, (SELECT DISTINCT portal FROM scan_history WHERE portal IS NOT NULL AND location IS NOT NULL) p WHERE NOT EXISTS (SELECT 1 FROM scan_history h WHERE h.portal = p.portal AND h.location = hood)"


def price_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """For each report, the largest price of the latest history day of its address up to the report's date."""
    r = read_table(spark, sf, "reports").where("url <> ''").select("report_id", "url", "created_on")
    h = read_table(spark, sf, "scan_history").where("price > 0 and url is not null").select("url", "first_seen", "price")
    return incremental.as_of(r, h, "url", "created_on", "first_seen", "price").select("report_id", F.col("as_of").alias("price"))


ASOF_SQL = """WITH h AS (SELECT url, first_seen, max(price) AS price FROM scan_history WHERE price > 0 AND url IS NOT NULL GROUP BY 1, 2)
SELECT report_id, h.price FROM (SELECT * FROM reports WHERE url <> '' AND created_on IS NOT NULL) r ASOF LEFT JOIN h ON r.url = h.url AND r.created_on >= h.first_seen"""


def near_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Range join: rows of the tracker and the whole inbox with one shape (5 % price, 3 m², rooms), counted per portal pair."""
    return linkage.near_counts(read_table(spark, sf, "tracker_additions"), read_table(spark, sf, "scan_inbox"))


NEAR_SQL = "SELECT a.portal AS portal_a, b.portal AS portal_b, count(*) AS n FROM tracker_additions a JOIN scan_inbox b ON a.price > 0 AND b.price > 0 AND a.m2 > 0 AND b.m2 > 0 AND a.rooms = b.rooms AND abs(a.price - b.price) / greatest(a.price, b.price) < 0.05 AND abs(a.m2 - b.m2) <= 3 GROUP BY ALL"

QUERIES = {f.__name__: f for f in (cross_source_links, best_match, footprint, seen_antijoin, failures_carried, merge_staged, updates_applied, notes_appended, reconcile_diffs, size_bands, missing_combinations, price_as_of, near_prices)}
ORACLES = dict(zip(QUERIES, (CROSS_SQL, BEST_SQL, FOOTPRINT_SQL, SEEN_SQL, CARRY_SQL, MERGE_SQL, APPLY_SQL, NOTES_SQL, _reconcile_sql(), BANDS_SQL, MISSING_SQL, ASOF_SQL, NEAR_SQL), strict=True))
QUERIES["best_match_known"] = best_match_known
