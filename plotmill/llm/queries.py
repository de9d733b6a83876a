"""Queries p1, p3, p4, p7, p8 and p9 with the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotmill.llm.addresses import building_classes, buildings, same_building_pairs
from plotmill.llm.leaks import leaked_items
from plotmill.llm.mixing import mix
from plotmill.llm.mojibake import garbled_documents, restored_documents
from plotmill.llm.token_index import ADVERT_PATTERNS, advert_tokens, known_rows
from plotmill.llm.vantage import record_links, similar_records
from plotmill.runtime import materialize, read_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows whose advert is known from the history, an earlier batch or an earlier row of the batch."""
    history = advert_tokens(read_table(spark, sf, "scan_history").withColumnRenamed("first_seen", "since"), ["since"])
    inbox = advert_tokens(read_table(spark, sf, "scan_inbox").withColumnRenamed("first_seen", "since"), ["entry_id", "batch_no", "since"])
    return known_rows(history, inbox)


def _advert_sql(table: str, extra: str) -> str:
    decoded = "url_decode(regexp_replace(lower(url), '^[\\s<\"'']+|[\\s>\"'']+$', '', 'g'))"
    codes = " ".join(f"WHEN site = '{s}' THEN regexp_extract(u, '{p.replace('(?![0-9a-z])', '')}', 1)" for s, p in ADVERT_PATTERNS.items())
    return f"""(SELECT {extra} site, CASE {codes} END AS code FROM (SELECT *, regexp_extract(regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)', 1), '([^.]+\\.[^.]+)$', 1) AS site
    FROM (SELECT *, {decoded} AS u FROM {table} WHERE url IS NOT NULL)))"""


P1_SQL = f"""
WITH h AS (SELECT DISTINCT site, code FROM {_advert_sql("scan_history", "")} WHERE code <> ''),
i AS (SELECT * FROM {_advert_sql("scan_inbox", "entry_id, batch_no,")} WHERE code <> '')
SELECT entry_id FROM (SELECT entry_id, row_number() OVER (PARTITION BY site, code ORDER BY batch_no, entry_id) AS k, h.code AS known FROM i LEFT JOIN h USING (site, code)) WHERE k > 1 OR known IS NOT NULL
"""


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracker rows at the same building."""
    return same_building_pairs(read_table(spark, sf, "tracker_additions"), read_table(spark, sf, "gazetteer"))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker rows with their building, by its smallest ``addition_id``, and the number of rows there."""
    return building_classes(read_table(spark, sf, "tracker_additions"), read_table(spark, sf, "gazetteer"))


def _flats(spark: SparkSession, sf: str) -> DataFrame:
    additions = read_table(spark, sf, "tracker_additions")
    placed = buildings(additions, read_table(spark, sf, "gazetteer")).withColumnRenamed("building", "grp")
    return materialize(additions.select(additions.addition_id.alias("row_id"), "price", "m2", "rooms").join(placed, "row_id"), "flats")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracker rows that record the same flat with small changes."""
    return similar_records(_flats(spark, sf)).toDF("addition_id_a", "addition_id_b")


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker rows with the class of their exact copies and the number of rows that record the same flat."""
    return record_links(_flats(spark, sf)).withColumnRenamed("row_id", "addition_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the evaluation items they leak."""
    return leaked_items(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn documents with their repeats."""
    return mix(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets")).documents


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets")).shares


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with text that was decoded wrongly."""
    return garbled_documents(read_table(spark, sf, "documents"))


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled documents with their original text, as far as it can be restored."""
    return restored_documents(read_table(spark, sf, "documents"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_classes": p4_classes, "p7_found": p7_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_restored": p9_restored}
P7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

ORACLES = {"p1_found": P1_SQL, "p7_found": P7_SQL}
