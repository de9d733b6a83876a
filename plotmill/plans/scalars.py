"""Queries of scalar functions: number dialects, text, addresses, places and dates, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.functions import dates, numbers, places, text
from plotmill.runtime import read_table

NOW = "2026-11-30 12:00:00"


def num_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """Every number dialect on the mirror's price texts."""
    p = F.col("price")
    return read_table(spark, sf, "scan_mirror").select("entry_id", *[f(p).alias(f"n_{k}") for k, f in numbers.DIALECTS.items() if k != "upper"]).distinct()


def _lead(t: str) -> str:
    return f"try_cast(nullif(regexp_extract({t}, '^\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS double)"


def _comma(t: str) -> str:
    return f"regexp_replace({t}, '^([^,]*),', '\\1.')"


def _groups(t: str) -> str:
    one = "regexp_replace({}, '\\.([0-9]{{3}})([^0-9]|$)', '\\1\\2', 'g')"
    return one.format(one.format(t))


_TOK = "regexp_extract(price, '[0-9][0-9.,]*[0-9]|[0-9]')"
_REP = "regexp_replace(price, '[^0-9.,-]', '', 'g')"
NUM_SQL = f"""SELECT DISTINCT entry_id,
coalesce({_lead(_comma(_groups("regexp_replace(price, '[^0-9.,]', '', 'g')")))}, 0) AS n_linkage,
coalesce({_lead(_comma(_groups("price")))}, 0) AS n_queue,
{_lead(f"CASE WHEN regexp_matches({_REP}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+(,[0-9]+)?$') OR regexp_matches({_REP}, ',[0-9]{{1,2}}$') THEN {_comma(f"replace({_REP}, '.', '')")} WHEN regexp_matches({_REP}, '^[0-9]+,[0-9]{{3}}$') THEN replace({_REP}, ',', '') ELSE {_REP} END")} AS n_report,
{_lead(f"CASE WHEN contains({_TOK}, '.') AND contains({_TOK}, ',') THEN CASE WHEN length(split_part({_TOK}, '.', -1)) < length(split_part({_TOK}, ',', -1)) THEN replace({_TOK}, ',', '') ELSE {_comma(f"replace({_TOK}, '.', '')")} END WHEN contains({_TOK}, '.') THEN CASE WHEN length(split_part({_TOK}, '.', -1)) = 3 THEN replace({_TOK}, '.', '') ELSE {_TOK} END WHEN contains({_TOK}, ',') THEN CASE WHEN length(split_part({_TOK}, ',', -1)) = 3 THEN replace({_TOK}, ',', '') ELSE {_comma(_TOK)} END ELSE {_TOK} END")} AS n_reconcile,
{_lead(f"regexp_replace({_comma("replace(price, '.', '')")}, '[^0-9.]', '', 'g')")} AS n_page,
{_lead(_comma("replace(regexp_extract(price, '[0-9.]+(?:,[0-9]+)?'), '.', '')"))} AS n_card,
{_lead(_comma("regexp_extract(price, '[0-9]+(?:[.,][0-9]+)?')"))} AS n_room,
try_cast(trim({_comma("price")}) AS double) AS n_score,
{_lead("price")} AS n_prefix
FROM scan_mirror"""


def num_range_upper(spark: SparkSession, sf: str) -> DataFrame:
    """Upper bounds of ranges, and rounding with halves up."""
    h = read_table(spark, sf, "scan_history").where("m2 > 0")
    cents = F.col("m2").cast("decimal(12,1)")
    return h.select("entry_id", numbers.upper_of_range(F.concat(cents.cast("string"), F.lit("–"), (cents + 5).cast("decimal(12,1)").cast("string"))).alias("upper"), numbers.round_half_up(F.col("m2") / 4, 1).alias("quarter"))


NUM_RANGE_SQL = "SELECT entry_id, CAST(CAST(m2 AS decimal(12,1)) + 5 AS double) AS upper, floor(m2 / 4 * 10.0 + 0.5) / 10.0 AS quarter FROM scan_history WHERE m2 > 0"


def url_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical form and page parameter of every inbox address."""
    u = F.col("url")
    return read_table(spark, sf, "scan_inbox").select("entry_id", text.canonical_url(u).alias("canonical"), text.with_page(u, F.col("batch_no")).alias("paged"))


URL_SQL = """SELECT entry_id, split_part(split_part(url, '#', 1), '?', 1) AS canonical,
CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN regexp_replace(url, '([?&])page=[0-9]+', '\\1page=' || batch_no, 'g') ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || batch_no END AS paged FROM scan_inbox"""


def url_harvest(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses printed in texts, canonical, with how many documents print them."""
    d = read_table(spark, sf, "documents")
    printed = d.select("doc_id", F.explode(F.array_distinct(text.urls_in(F.concat_ws(" | ", F.lit("see"), "url", "text")))).alias("u"))
    return printed.groupBy(text.canonical_url(F.col("u")).alias("url")).agg(F.count_distinct("doc_id").alias("n_docs"))


HARVEST_SQL = """SELECT split_part(split_part(u, '#', 1), '?', 1) AS url, count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, unnest(regexp_extract_all(concat_ws(' | ', 'see', url, text), 'https?://[^\\s|)\\]]+')) AS u FROM documents) GROUP BY 1"""


def tsv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """History rows as tab-separated lines; unknown numbers are empty."""
    h = read_table(spark, sf, "scan_history")
    number = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c).cast("decimal(14,2)").cast("string")), F.lit(""))
    return h.select("entry_id", F.concat_ws("\t", *[text.tsv_field(F.col(c)) for c in ("url", "portal", "title", "location")], *[number(c) for c in ("price", "m2", "rooms")], text.tsv_field(F.col("status"))).alias("line"))


_TSV_FIELD = "coalesce(regexp_replace({0}, '[\\t\\r\\n]+', ' ', 'g'), '')"
_TSV_NUM = "coalesce(CASE WHEN {0} <> 0 THEN CAST(CAST({0} AS decimal(14,2)) AS varchar) END, '')"
TSV_SQL = f"SELECT entry_id, concat_ws(chr(9), {', '.join(_TSV_FIELD.format(c) for c in ('url', 'portal', 'title', 'location'))}, {', '.join(_TSV_NUM.format(c) for c in ('price', 'm2', 'rooms'))}, {_TSV_FIELD.format('status')}) AS line FROM scan_history"


def title_features(spark: SparkSession, sf: str) -> DataFrame:
    """Squashed title, number of distinctive words, comparable key and unit codes."""
    t = F.col("title")
    coded = F.concat_ws(" ", t, F.concat(F.lit("H"), F.pmod("entry_id", F.lit(9)).cast("string"), F.lit("-0"), F.pmod("entry_id", F.lit(7)).cast("string"), F.lit("-1"), F.pmod("entry_id", F.lit(3)).cast("string")))
    return read_table(spark, sf, "scan_history").select("entry_id", text.squash(t).alias("squashed"), F.size(text.title_tokens(t)).alias("n_tokens"), text.title_key(t).alias("title_key"), F.array_join(text.unit_codes(coded), ",").alias("codes"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-zäöüß]+'), lambda w: length(w) >= 4 AND NOT list_contains([" + ",".join(f"'{w}'" for w in text.TITLE_STOPWORDS) + "], w)))"
_KEY = "trim(left(trim(regexp_replace(replace(replace(replace(replace(lower(coalesce(title, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), 45))"
TITLE_SQL = f"""SELECT entry_id, regexp_replace(lower(title), '[^a-zäöüß0-9]+', '', 'g') AS squashed, CAST(len({_WORDS}) AS integer) AS n_tokens,
CASE WHEN len({_WORDS}) >= 2 AND length({_KEY}) >= 20 THEN {_KEY} ELSE '' END AS title_key, 'H' || entry_id % 9 || '-0' || entry_id % 7 || '-1' || entry_id % 3 AS codes FROM scan_history"""


def report_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Headers, heading and a section of every report text."""
    t = F.col("text")
    d = read_table(spark, sf, "documents").where(F.lower(F.trim("source")) == "report")
    return d.select("doc_id", text.report_header(t, "Date").alias("date"), text.report_header(t, "Score").alias("score"), text.heading_parts(t).getField("title").alias("title"), text.heading_parts(t).getField("place").alias("place"), F.length(text.section(t, "Summary")).alias("summary_chars"))


REPORT_SQL = """SELECT doc_id, trim(regexp_extract(text, '(?im)^\\*\\*Date:\\*\\*[ \\t]*(.*)$', 1)) AS date, trim(regexp_extract(text, '(?im)^\\*\\*Score:\\*\\*[ \\t]*(.*)$', 1)) AS score,
trim(CASE WHEN regexp_matches(h, '^.+ — ') THEN regexp_extract(h, '^(.+) — ', 1) ELSE h END) AS title, regexp_extract(h, '^.+ — (.*)$', 1) AS place,
length(regexp_replace(CASE WHEN regexp_matches(text, '(?im)^##\\s+Summary[^\\n]*\\n') THEN regexp_replace(regexp_replace(text, '(?ims)^.*?^##\\s+Summary[^\\n]*\\n', ''), '(?ms)^##\\s.*$', '') ELSE '' END, '^\\s+|\\s+$', '', 'g')) AS summary_chars
FROM (SELECT *, regexp_extract(trim(split_part(text, chr(10), 1)), '(?i)^#\\s*Evaluation:\\s*(.*)$', 1) AS h FROM documents WHERE lower(trim(source)) = 'report')"""


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown stripped, HTML escaped, slugs, German numbers and encoded place names."""
    a = read_table(spark, sf, "tracker_additions")
    return a.select("addition_id", text.strip_markdown(F.col("report")).alias("plain"), text.report_path(F.col("report")).alias("path"), text.escape_html(F.concat(F.lit('<b class="x">'), F.col("notes"))).alias("html"), text.slug(F.col("location")).alias("slug"), text.german_integer(F.col("price")).alias("price_de"), text.german_decimal(F.col("m2")).alias("m2_de"), text.queue_field(F.col("notes")).alias("queue"))


TEXT_SQL = """SELECT addition_id,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(report, ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*\\*|__|`', '', 'g'), '(^|\\s)\\*([^*]+)\\*', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS plain,
regexp_extract(coalesce(report, ''), '\\(([^)]*\\.md)\\)', 1) AS path, replace(replace(replace(replace('<b class="x">' || notes, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
regexp_replace(regexp_replace(replace(replace(replace(replace(lower(location), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
coalesce(replace(format('{:,}', CAST(floor(price + 0.5) AS bigint)), ',', '.'), '') AS price_de,
coalesce(replace(regexp_replace(CAST(CAST(floor(m2 * 100 + 0.5) / 100 AS decimal(18,2)) AS varchar), '\\.?0+$', ''), '.', ','), '') AS m2_de,
trim(regexp_replace(replace(coalesce(notes, ''), '|', '/'), '\\s+', ' ', 'g')) AS queue FROM tracker_additions"""


def place_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbourhood, postcodes and region of every history location."""
    loc = F.col("location")
    from plotmill.plans.linkage import town_names

    towns = town_names(spark, sf)
    return read_table(spark, sf, "scan_history").select("entry_id", places.neighbourhood(loc, towns).alias("hood"), F.array_join(places.postcodes(loc), ",").alias("codes"), places.outside_region(loc, ["43", "625"]).alias("outside"))


PLACE_SQL = """WITH t AS (SELECT list(DISTINCT lower(regexp_replace(town, ' (an der|am) .*', ''))) AS towns FROM gazetteer)
SELECT entry_id, coalesce(list_filter(list_transform(string_split(lower(coalesce(location, '')), ','), lambda f: trim(regexp_replace(regexp_replace(regexp_replace(f, '\\b[0-9]{4,5}\\b', ' ', 'g'), '[^a-zäöüß ]+', ' ', 'g'), ' +', ' ', 'g'))), lambda f: f <> '' AND NOT list_contains(towns, f))[-1], '') AS hood,
array_to_string(regexp_extract_all(coalesce(location, ''), '\\b[0-9]{5}\\b'), ',') AS codes,
len(regexp_extract_all(coalesce(location, ''), '\\b[0-9]{5}\\b')) > 0 AND NOT regexp_matches(array_to_string(regexp_extract_all(coalesce(location, ''), '\\b[0-9]{5}\\b'), ','), '(^|,)(43|625)') AS outside FROM scan_history, t"""


def place_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Whether neighbouring gazetteer hoods (by name) agree, differ or can't be told."""
    from pyspark.sql import Window

    g = read_table(spark, sf, "gazetteer").select("plz", F.trim(F.regexp_replace(F.regexp_replace(F.lower("hood"), "[^a-zäöüß ]+", " "), " +", " ")).alias("a"))
    w = Window.orderBy("a", "plz")
    pairs = g.select("plz", "a", F.lead("a", 1).over(w).alias("b")).where("b is not null")
    bare = g.select("plz", "a", F.element_at(F.split("a", " "), 1).alias("b"))
    return pairs.unionByName(bare).select("plz", "a", "b", places.neighbourhoods_agree(F.col("a"), F.col("b")).cast("string").alias("agree"))


AGREE_SQL = """WITH g AS (SELECT plz, trim(regexp_replace(regexp_replace(lower(hood), '[^a-zäöüß ]+', ' ', 'g'), ' +', ' ', 'g')) AS a FROM gazetteer),
p AS (SELECT plz, a, lead(a) OVER (ORDER BY a, plz) AS b FROM g UNION ALL SELECT plz, a, split_part(a, ' ', 1) FROM g),
s AS (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM p WHERE b IS NOT NULL),
x AS (SELECT *, list_filter(ta, lambda t: NOT list_contains(tb, t)) AS ma, list_filter(tb, lambda t: NOT list_contains(ta, t)) AS mb FROM s)
SELECT plz, a, b, CASE WHEN a = b THEN 'true' WHEN len(ma) = len(ta) OR len(list_filter(list_concat(ma, mb), lambda t: regexp_full_match(t, 'i{1,3}|iv|v|nord|n[öo]rdliche|süd|sued|s[üu]dliche|ost|[öo]stliche|west|westliche|mitte'))) > 0 THEN 'false' WHEN len(ma) = 0 OR len(mb) = 0 THEN 'true' END AS agree FROM x"""


def note_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Next steps named in the correspondence: due date and who acts."""
    d = read_table(spark, sf, "documents").where(F.lower(F.trim("source")) == "correspondence")
    step = F.regexp_extract("text", "(?m)^\\*\\*Next:\\*\\*[ \\t]*(.*)$", 1)
    last = F.when(F.regexp_extract("text", "(?s).*(received|sent)", 1) == "received", "received").otherwise("sent")
    return d.select("doc_id", step.alias("step"), last.alias("last"), "created_on").where("step <> ''").select("doc_id", dates.due_date(F.col("step"), F.col("created_on")).alias("due"), dates.owner(F.col("step"), F.col("last")).alias("owner"))


NOTE_SQL = """WITH s AS (SELECT doc_id, regexp_extract(text, '(?m)^\\*\\*Next:\\*\\*[ \\t]*(.*)$', 1) AS step, regexp_extract(text, '(?s).*(received|sent)', 1) AS last, created_on FROM documents WHERE lower(trim(source)) = 'correspondence')
SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(step, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS date), CAST(try_strptime(nullif(regexp_extract(step, '[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}'), ''), '%d.%m.%Y') AS date),
CAST(try_strptime(nullif(regexp_extract(step, '([0-9]{1,2}\\.[0-9]{1,2}\\.)(?:[^0-9]|$)', 1), '') || year(created_on), '%d.%m.%Y') AS date),
created_on + try_cast(nullif(regexp_extract(step, '(?i)(?:within|innerhalb(?: von)?)\\s+([0-9]{1,4})\\s+(?:day|tag)', 1), '') AS integer), CASE WHEN regexp_matches(step, '(?i)asap|⏰|sofort|umgehend') THEN created_on END) AS due,
CASE WHEN regexp_matches(step, '(?i)^\\s*(?:⏰\\s*)?(?:confirm|reply|send|submit|apply|attend|obtain|pre-stage|prepare|call|ask|schedule|request|antworten|bestätigen|senden|einreichen|anrufen|nachfragen|besichtigen)') THEN 'us'
WHEN regexp_matches(step, '(?i)^\\s*(?:await|waiting|wait for|they|landlord|vermieter|hv)\\b') THEN 'them' WHEN last = 'received' THEN 'us' ELSE 'them' END AS owner FROM s WHERE step <> ''"""


def day_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days past and until, month keys, month ends and three months on."""
    now = F.lit(NOW).cast("timestamp_ntz")
    return read_table(spark, sf, "tracker_additions").select("addition_id", dates.days_past(F.col("add_date"), now).alias("past"), dates.days_until(F.col("add_date"), now).alias("until"), dates.month_key(F.col("add_date")).alias("month"), F.last_day("add_date").alias("month_end"), F.add_months("add_date", 3).alias("expires"))


DAY_SQL = f"""SELECT addition_id, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(CAST(add_date AS timestamp))) / 86400) AS bigint) AS past, CAST(ceil((epoch(CAST(add_date AS timestamp)) - epoch(TIMESTAMP '{NOW}')) / 86400) AS bigint) AS until,
strftime(add_date, '%Y-%m') AS month, last_day(add_date) AS month_end, CAST(add_date + INTERVAL 3 MONTH AS date) AS expires FROM tracker_additions"""


def template_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Search addresses with bound parameters; parameters without a value stay and are listed."""
    a = read_table(spark, sf, "tracker_additions")
    r = text.resolve_template(F.lit("https://x.example/s?p={price_max}&r={rooms_min}&z={zone}"), {"price_max": F.when(F.col("price") > 0, F.col("price").cast("bigint")), "rooms_min": F.when(F.col("rooms") > 0, F.col("rooms").cast("decimal(6,1)"))})
    return a.select("addition_id", r.alias("r")).select("addition_id", "r.url", F.array_join("r.unresolved", ",").alias("unresolved"))


TEMPLATE_SQL = """SELECT addition_id, 'https://x.example/s?p=' || CASE WHEN price > 0 THEN CAST(CAST(trunc(price) AS bigint) AS varchar) ELSE '{price_max}' END || '&r=' || CASE WHEN rooms > 0 THEN CAST(CAST(rooms AS decimal(6,1)) AS varchar) ELSE '{rooms_min}' END || '&z={zone}' AS url,
concat_ws(',', CASE WHEN price > 0 THEN NULL ELSE 'price_max' END, CASE WHEN rooms > 0 THEN NULL ELSE 'rooms_min' END, 'zone') AS unresolved FROM tracker_additions"""


def predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Shape, plausibility and class predicates."""
    a = read_table(spark, sf, "tracker_additions")
    return a.select(
        "addition_id",
        F.col("notes").rlike("(?i)tausch").alias("swap"),
        F.col("notes").rlike("[0-9] ?(EUR|€)").alias("priced"),
        F.when(F.col("price").between(100, 10000), F.col("price")).alias("price_ok"),
        F.when(F.col("m2").between(15, 250), F.col("m2")).alias("m2_ok"),
        F.when(F.col("rooms").between(1, 12), F.col("rooms")).alias("rooms_ok"),
        text.error_class(F.col("notes")).alias("class"),
    )


PREDICATE_SQL = """SELECT addition_id, regexp_matches(notes, '(?i)tausch') AS swap, regexp_matches(notes, '[0-9] ?(EUR|€)') AS priced, CASE WHEN price BETWEEN 100 AND 10000 THEN price END AS price_ok,
CASE WHEN m2 BETWEEN 15 AND 250 THEN m2 END AS m2_ok, CASE WHEN rooms BETWEEN 1 AND 12 THEN rooms END AS rooms_ok,
CASE WHEN regexp_matches(lower(notes), '403|forbidden|net::err|blocked|err_http2|access denied') THEN 'bot_defense' WHEN regexp_matches(lower(notes), 'timeout|timed out|navigation') THEN 'transient' ELSE 'error' END AS class FROM tracker_additions"""

QUERIES = {f.__name__: f for f in (num_dialects, num_range_upper, url_forms, url_harvest, tsv_lines, title_features, report_fields, text_forms, place_tokens, place_agreement, note_dates, day_differences, template_urls, predicates)}
ORACLES = dict(zip(QUERIES, (NUM_SQL, NUM_RANGE_SQL, URL_SQL, HARVEST_SQL, TSV_SQL, TITLE_SQL, REPORT_SQL, TEXT_SQL, PLACE_SQL, AGREE_SQL, NOTE_SQL, DAY_SQL, TEMPLATE_SQL, PREDICATE_SQL), strict=True))
