"""Table differences, lines that fail to parse and references without a target: edge cases and brute force."""

import datetime
import random

from pyspark.sql import functions as F

from plotmill.functions.exact_numbers import exact_from_double, exact_from_text
from plotmill.operators import references as refs
from plotmill.operators.table_diff import differing_ranges, table_diff
from plotmill.sources.delimited import line_errors, parse_tracker_lines, tracker_rows

D = datetime.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def diff(a, b, **more):
    return rows(table_diff(a, b, "k", ["x", "y"], left_name="a", right_name="b", **more))


def test_exact_numbers(spark):
    cases = {"1.220": 1220, "1.263,00": 1263, "75.70": 75.7, "68,5": 68.5, "1 273": 1273, "€ 1.854,15": 1854.15, "78m²": 78, "2½": 2.5, "k. A.": None, "": None, "-": None, "0": None, "0,00 €": None, None: None, "1.516,13 EUR": 1516.13, "9.999.999": 9999999, "5,0 Zi.": 5, "-3": -3}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", exact_from_text(F.col("t")).cast("double").alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases
    df = spark.createDataFrame([(81.9,), (0.0,), (float("nan"),), (None,)], "v double").select(exact_from_double(F.col("v")).cast("string").alias("v"))
    assert [r.v for r in df.collect()] == ["81.9", None, None, None]


def test_exact_numbers_have_no_bound(spark):
    """The same number in two notations is equal at any size, and numbers that differ anywhere aren't."""
    texts = ["1,00001", "1,00002", "123456789012345678901234567890", "12.345.678.901.234.567.890,5", "-0,50", "007", "1e5 m"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(exact_from_text(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == ["1.00001", "1.00002", "123456789012345678901234567890", "12345678901234567890.5", "-0.5", "7", "1"]
    numbers = [1e7, 1.5e22, 1.25e-5, -3.0, 12345678.25, 1e-300, float("inf"), -0.0, 5e-324]
    df = spark.createDataFrame([(n,) for n in numbers], "n double").select("n", exact_from_double(F.col("n")).alias("v"))
    got = [r.v for r in df.collect()]
    assert got[:5] == ["10000000", "15" + "0" * 21, "0.0000125", "-3", "12345678.25"] and got[6:8] == [None, None]
    assert all(v is None or float(v) == n for n, v in zip(numbers, got))


def test_table_diff_cases(spark):
    s = "k bigint, x double, y string, other string"
    a = spark.createDataFrame([(1, 1.0, "u", "p"), (2, None, None, "p"), (3, 3.0, "v", "p"), (5, 5.0, "w", "p"), (None, 1.0, "u", "p"), (-7, 1.0, "u", "p")], s)
    b = spark.createDataFrame([(1, 1.0, "u", "q"), (1, 1.0, "u", "q"), (2, 2.0, None, "q"), (3, None, "z", "q"), (4, 4.0, "n", "q"), (-7, 1.0, "u", "p")], s)
    want = [(2, "x"), (3, "x"), (3, "y"), (4, "missing_in_a"), (5, "missing_in_b"), (None, "missing_in_b")]
    assert diff(a, b) == sorted(want, key=str)
    assert set(diff(a, a)) == {(None, "missing_in_a"), (None, "missing_in_b")}
    empty = a.limit(0)
    assert diff(empty, empty) == []
    assert len(diff(a.where("k is not null"), empty)) == 5


def test_table_diff_swapped_null_is_seen(spark):
    a = spark.createDataFrame([(1, 7.0, None)], "k bigint, x double, y double")
    b = spark.createDataFrame([(1, None, 7.0)], "k bigint, x double, y double")
    assert diff(a, b) == [(1, "x"), (1, "y")]


def test_table_diff_descends(spark):
    """Wide, sparse keys: several levels, and the result of brute force."""
    rng = random.Random(1)
    keys = rng.sample(range(-(10**9), 10**9), 3000)
    a = {k: (float(k % 5), str(k % 3)) for k in keys}
    b = {k: v if rng.random() > 0.02 else (v[0] + 1, v[1]) for k, v in a.items() if rng.random() > 0.01}
    b |= {k: (1.0, "n") for k in rng.sample(range(2 * 10**9, 3 * 10**9), 20)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k bigint, x double, y string")
    want = {(k, "missing_in_b") for k in a.keys() - b.keys()} | {(k, "missing_in_a") for k in b.keys() - a.keys()} | {(k, "x") for k in a.keys() & b.keys() if a[k][0] != b[k][0]}
    assert set(diff(frame(a), frame(b))) == want


def brute_diff(a, b):
    """Field by field over all pairs of copies."""
    out = set()
    for k in {r[0] for r in a} | {r[0] for r in b}:
        l, r = [x for x in a if x[0] == k], [x for x in b if x[0] == k]
        out |= {(k, "missing_in_b")} if not r else {(k, "missing_in_a")} if not l else {(k, f) for x in l for y in r for f, p, q in (("x", x[1], y[1]), ("y", x[2], y[2])) if p != q}
    return out


def test_table_diff_of_doubled_rows(spark):
    """Copies don't cancel in a checksum, whether the key or only a value differs."""
    frame = lambda d: spark.createDataFrame(d, "k bigint, x double, y string")
    assert diff(frame([(1, 1.0, "u")] * 2), frame([(2, 5.0, "u")] * 2)) == [(1, "missing_in_b"), (2, "missing_in_a")]
    assert diff(frame([(1, 1.0, "u")] * 2), frame([(1, 5.0, "u")] * 2)) == [(1, "x")]
    rng = random.Random(3)
    row = lambda: (rng.randint(0, 60), float(rng.randint(0, 2)), rng.choice(["u", None]))
    for copies in (2, 4):
        a, b = [[r for r in (row() for _ in range(60)) for _ in range(rng.choice([1, copies]))] for _ in range(2)]
        assert set(diff(frame(a), frame(b))) == brute_diff(a, b)


def test_table_diff_bisects_over_three_levels(spark):
    """With a fan-out of 4 only children of ranges that differ are looked at."""
    a = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"), F.lit("u").alias("y"))
    b = a.withColumn("x", F.when(F.col("k").isin(5, 3111), -1.0).otherwise(F.col("x")))
    levels = [sorted(r.range for r in t.collect()) for t in differing_ranges(a, b, "k", ["x", "y"], fanout=4)]
    assert len(levels) == 5 and levels[-1] == [0, 388] and all(len(v) <= 2 for v in levels)
    assert all(sorted({r // 4 for r in down}) == up for up, down in zip(levels, levels[1:]))
    assert set(diff(a, b, fanout=4)) == {(5, "x"), (3111, "x")}


GOOD = "7\t2026-01-01\tP\tmiete\tOrt\t1.200\t60,5\t2\t3.4\tNew\treports/7.md"


def reference_parse(line):
    """A character-by-character tokenizer."""
    if line is None or not line.strip(" ") or line.startswith("num\t"):
        return "skipped"
    cells, k = [], 0
    while True:
        if k < len(line) and line[k] == '"':
            k, text = k + 1, ""
            while True:
                if k >= len(line):
                    return "quotes"
                if line[k] == '"':
                    if line[k + 1 : k + 2] == '"':
                        text, k = text + '"', k + 2
                        continue
                    k += 1
                    break
                text, k = text + line[k], k + 1
            if k < len(line) and line[k] != "\t":
                return "quotes"
        else:
            end = line.find("\t", k)
            end = len(line) if end < 0 else end
            text, k = line[k:end], end
        cells.append(text)
        if k >= len(line):
            break
        k += 1
    if len(cells) not in (11, 12):
        return "columns"
    num = cells[0].strip(" ")
    if not (num.isascii() and num.isdigit() and 1 <= len(num) <= 9 and int(num)):
        return "num"
    if len(cells) == 12 and any((c < " " and c != "\t") or c in "\x7f�" for c in cells[11]):
        return "notes"
    return cells


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    lines = [None, "", "   ", "num\tx", GOOD, GOOD + "\tnote", GOOD + '\t"a ""b""\tc"', GOOD + '\t"open', GOOD + '\t"x" y', GOOD + '\tok"', GOOD + "\t\x07", GOOD + "\ta b", " 7" + GOOD[1:], " 7 " + GOOD[1:], "0" + GOOD[1:], "0000000000" + GOOD[1:], '"7"' + GOOD[1:], "\t" * 11, '"' * 5, GOOD + "\n", "x" * 50_000, '"' + "a" * 200_000 + '"' + GOOD[1:]]
    for _ in range(600):
        lines.append("".join(rng.choice(['"', '""', "\t", "\t", "a", "7", " ", "\x00", "�"]) for _ in range(rng.randint(0, 30))))
        cells = [rng.choice(["7", " 12 ", '"5"', "x", "", '"a\tb"', '"q""q"', 'p"q']) for _ in range(rng.choice([10, 11, 11, 12, 12, 13]))]
        lines.append("\t".join(cells))
    parsed = parse_tracker_lines(spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")).cache()
    got = {r.line_id: r.reason or [r[f"c_{n}"] for n in ("num", "add_date", "portal", "offer_type", "location", "price", "m2", "rooms", "score", "status", "report", "notes")] for r in parsed.collect()}
    for k, line in enumerate(lines):
        want = reference_parse(line)
        if isinstance(want, list):
            want = want + [None] * (12 - len(want))
        assert got.get(k, "skipped") == want, line[:80]
    assert all(r.offset is not None and 0 <= r.offset <= len(lines[r.line_id]) for r in line_errors(parsed).collect())


def test_typed_rows_and_clashing_names(spark):
    lines = spark.createDataFrame([(1, GOOD + "\tn", "z", 5)], "line_id bigint, line string, reason string, text int")
    (r,) = tracker_rows(parse_tracker_lines(lines)).collect()
    assert (r.num, r.add_date, r.price, r.m2, r.rooms, r.score, r.notes) == (7, D(2026, 1, 1), 1200.0, 60.5, 2.0, 3.4, "n")
    assert tracker_rows(parse_tracker_lines(lines.limit(0))).collect() == []


def frames_of(spark, referring, existing):
    return spark.createDataFrame(referring, "id bigint, key string, on date"), spark.createDataFrame(existing, "key string, since date, deleted date")


def deltas_of(r, e, sign=1):
    key = F.col("key")
    return [refs.reference_deltas(r, "t", key, F.col("on"), sign), refs.existence_deltas(e, "t", key, F.col("since"), sign), refs.deletion_deltas(e.where("deleted is not null"), "t", key, F.col("since"), sign)]


def ledger_of(spark, referring, existing):
    r, e = frames_of(spark, referring, existing)
    return r, refs.fold(*deltas_of(r, e))


def test_orphans(spark):
    r, ledger = ledger_of(
        spark,
        [(1, "a", D(2026, 1, 5)), (2, "b", D(2026, 1, 5)), (3, "c", D(2026, 2, 1)), (4, "d", D(2026, 2, 1)), (5, None, D(2026, 2, 1)), (6, "c", D(2026, 4, 1)), (7, "c", None), (8, "a", None)],
        [("b", D(2026, 1, 1), None), ("b", D(2026, 1, 1), None), ("c", D(2026, 3, 1), None), ("d", D(2026, 1, 1), D(2026, 5, 1)), ("unused", D(2026, 1, 1), None), (None, None, None)],
    )
    referring = r.select(F.lit("t").alias("ref_table"), F.col("id").alias("ref_id"), "key", F.col("on").alias("ref_on"))
    got = rows(refs.orphan_rows(referring, ledger))
    assert got == sorted([("t", 1, "missing", "2026-01"), ("t", 3, "late", "2026-02"), ("t", 4, "deleted", "2026-02"), ("t", 8, "missing", None)], key=str)
    assert refs.orphan_rows(referring.limit(0), ledger).count() == 0


def test_ledger_is_incremental(spark):
    r1, first = ledger_of(spark, [(1, "a", D(2026, 1, 1))], [("b", D(2026, 1, 1), None)])
    more = spark.createDataFrame([("a", D(2026, 1, 1))], "key string, since date")
    both = refs.fold(first, refs.existence_deltas(more, "t", F.col("key"), F.col("since")))
    assert refs.suspects(first).count() == 1
    assert refs.suspects(both).count() == 0
    # a live record that is deleted later makes its reference an orphan
    deleted = refs.fold(both, refs.deletion_deltas(more, "t", F.col("key"), F.col("since")))
    (orphan,) = refs.orphan_keys(deleted).collect()
    assert (orphan.key, orphan.refs, orphan.live, orphan.ever) == ("a", 1, 0, 1)
    gone = refs.fold(deleted, refs.reference_deltas(r1, "t", F.col("key"), F.col("on"), sign=-1))
    assert refs.orphan_keys(gone).count() == 0


def test_dates_are_withdrawn(spark):
    """The record from January goes, the one from March stays: a reference from February is late then."""
    r, e = frames_of(spark, [(1, "a", D(2026, 2, 1))], [("a", D(2026, 1, 1), None), ("a", D(2026, 3, 1), None)])
    both = refs.fold(*deltas_of(r, e))
    assert refs.suspects(both).count() == 0
    withdrawn = refs.fold(both, refs.existence_deltas(e.where("since < '2026-02-01'"), "t", F.col("key"), F.col("since"), sign=-1))
    assert [(x.key, x.since) for x in refs.suspects(withdrawn).collect()] == [("a", D(2026, 3, 1))]


def test_kept_ledger_equals_the_rebuilt_one(spark, tmp_path):
    """Batches that come and go in any order, with compaction in between, opened anew for each batch."""
    rng = random.Random(5)
    day = lambda: rng.choice([None, D(2026, rng.randint(1, 6), 1)])
    path, everything, applied = f"file://{tmp_path}/ledger", [], []
    keep, refs.ReferenceLedger.COMPACT_AFTER = refs.ReferenceLedger.COMPACT_AFTER, 3
    try:
        for k in range(6):
            r, e = frames_of(spark, [(n, rng.choice(["a", "b", "c", None]), day()) for n in range(6)], [(rng.choice("abc"), day(), rng.choice([None, D(2026, 7, 1)])) for _ in range(3)])
            batch = deltas_of(r, e) + ([] if k % 3 else [refs.fold(*applied[-1]).select("ref_table", "key", "on", *[(-F.col(c)).alias(c) for c in ("refs", "live", "ever")])] if applied else [])
            ledger = refs.ReferenceLedger(spark, path)
            ledger.apply(refs.fold(*batch))
            applied.append(batch)
            everything += batch
            assert rows(ledger.current()) == rows(refs.fold(*everything))
    finally:
        refs.ReferenceLedger.COMPACT_AFTER = keep
    assert refs.ReferenceLedger(spark).current().count() == 0


def test_hot_key(spark):
    """A third of all rows refer to one missing key."""
    n = 3000
    data = [(k, "hot" if k % 3 == 0 else f"k{k}", D(2026, 1, 1)) for k in range(n)]
    r, ledger = ledger_of(spark, data, [(f"k{k}", D(2025, 1, 1), None) for k in range(n)])
    referring = r.select(F.lit("t").alias("ref_table"), F.col("id").alias("ref_id"), "key", F.col("on").alias("ref_on"))
    assert refs.orphan_rows(referring, ledger).count() == n // 3
