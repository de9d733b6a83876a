"""Pairs of near-duplicate records by vantage points: fingerprints partitioned by Hamming distance.

A fingerprint is a thermometer code: a value in bin k sets the lowest k bits, so the Hamming distance of two codes is
the sum of the differences of their bins. Bins are as wide as the tolerance of their field, hence two records within
tolerance in two fields are at a distance of 2 at most. The root splits the fingerprints of a group into shards by
their distance from the empty code; fingerprints within the radius of a shard's upper bound also visit the next one. In
a shard a vantage-point tree prunes by the triangle inequality, and only boundary-overlapping branches meet. Records of
one fingerprint are a leaf of the tree, which pairs with itself. Pairs of fingerprints are then checked exactly on the
records' values. Records with equal values are one class throughout and only expanded where all pairs are wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmill.runtime import materialize, shuffle_partitions

RADIUS = 2
#: Distances from the empty code per shard of the root.
SHARD_WIDTH = 24
LEAF = 12
#: Cells that one Python task holds.
CELLS_PER_TASK = 50_000
#: Bits of one field's code; values in higher bins share the last one, which never enlarges a distance.
BITS = 512

#: Tolerances within which two records' fields agree.
PRICE_SHARE, M2_SPAN, ROOMS_SPAN = 0.05, 3.0, 0.5
FIELDS = ("price", "m2", "rooms")
COMBINATIONS = (("price", "m2"), ("price", "rooms"), ("m2", "rooms"))


def _bin(field: str) -> Column:
    """Bins of which values within tolerance differ by one at most; a hair wider, for rounding at the bounds."""
    v = F.col(field)
    if field == "price":
        raw = F.log(v) / (-math.log(1 - PRICE_SHARE) * 1.0001)
    else:
        raw = v / ((M2_SPAN if field == "m2" else ROOMS_SPAN) * 1.0001)
    return F.least(F.greatest(F.floor(raw), F.lit(0)), F.lit(BITS)).cast("int")


def near_pairs(codes: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """All index pairs of codes within ``radius``, each once, by a vantage-point tree."""
    alone: list[list[int]] = [list(range(len(codes)))]
    across: list[tuple[list[int], list[int]]] = []
    while alone:
        part = alone.pop()
        if len(part) <= LEAF:
            for x, i in enumerate(part):
                for j in part[x + 1 :]:
                    if (codes[i] ^ codes[j]).bit_count() <= radius:
                        yield i, j
            continue
        far = [(codes[i] ^ codes[part[len(part) // 2]]).bit_count() for i in part]
        mu = sorted(far)[len(far) // 2]
        if mu == max(far):
            mu -= 1
        inner = [i for i, d in zip(part, far, strict=True) if d <= mu]
        outer = [i for i, d in zip(part, far, strict=True) if d > mu]
        if not inner or not outer:
            across.append((part[:1], part[1:]))
            alone.append(part[1:])
            continue
        alone += [inner, outer]
        across.append(([i for i, d in zip(part, far, strict=True) if mu - radius < d <= mu], [i for i, d in zip(part, far, strict=True) if mu < d <= mu + radius]))
        while across:
            left, right = across.pop()
            if len(left) > len(right):
                left, right = right, left
            if len(left) <= LEAF:
                for i in left:
                    for j in right:
                        if (codes[i] ^ codes[j]).bit_count() <= radius:
                            yield i, j
                continue
            v = codes[left[len(left) // 2]]
            a, b = [(codes[i] ^ v).bit_count() for i in left], [(codes[i] ^ v).bit_count() for i in right]
            mu = sorted(a)[len(a) // 2]
            if mu == max(a):
                mu -= 1
            low = [i for i, d in zip(left, a, strict=True) if d <= mu]
            high = [i for i, d in zip(left, a, strict=True) if d > mu]
            if not low or not high:
                across += [(left[:LEAF], right), (left[LEAF:], right)]
                continue
            across.append((low, [i for i, d in zip(right, b, strict=True) if d <= mu + radius]))
            across.append((high, [i for i, d in zip(right, b, strict=True) if d > mu - radius]))
    while across:
        left, right = across.pop()
        for i in left:
            for j in right:
                if (codes[i] ^ codes[j]).bit_count() <= radius:
                    yield i, j


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of cells within the radius, in each (group, combination, shard); a visitor pairs with residents only, and a
    resident that holds several records with itself."""
    out = []
    pdf = pdf.sort_values(["grp", "combo", "shard"], kind="stable")
    keys = list(zip(pdf["grp"], pdf["combo"], pdf["shard"], strict=True))
    x, y, home, several = pdf["x"].tolist(), pdf["y"].tolist(), pdf["home"].tolist(), pdf["several"].tolist()
    begin = 0
    for end in range(1, len(keys) + 1):
        if end < len(keys) and keys[end] == keys[begin]:
            continue
        g, c, shard = keys[begin]
        out += [(g, c, x[k], y[k], x[k], y[k]) for k in range(begin, end) if several[k] and home[k] == shard]
        if end - begin > 1:
            codes = [(1 << x[k]) - 1 | (1 << y[k]) - 1 << BITS for k in range(begin, end)]
            for i, j in near_pairs(codes):
                i, j = i + begin, j + begin
                if home[i] == shard or home[j] == shard:
                    out.append((g, c, x[i], y[i], x[j], y[j]))
        begin = end
    return pd.DataFrame(out, columns=["grp", "combo", "xa", "ya", "xb", "yb"])


def _known(rows: DataFrame) -> DataFrame:
    """Rows with a group; unknown values are 0."""
    return rows.where(F.col("grp").isNotNull() & F.col("row_id").isNotNull()).select("row_id", "grp", *[F.when(~F.isnan(f) & (F.col(f) > 0), F.col(f)).otherwise(0.0).alias(f) for f in FIELDS])


def record_classes(rows: DataFrame) -> DataFrame:
    """``grp, price, m2, rooms, class_id, n``: the distinct records of each group, by their smallest ``row_id``."""
    return _known(rows).groupBy("grp", *FIELDS).agg(F.min("row_id").alias("class_id"), F.count(F.lit(1)).alias("n"))


def similar_classes(classes: DataFrame) -> DataFrame:
    """``a, na, b, nb``: pairs of classes ``a <= b`` whose records agree within tolerance, with their sizes; a class of
    several records that know two fields is paired with itself."""
    spark = classes.sparkSession
    several = classes.groupBy("grp").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("grp")
    binned = classes.join(several, "grp", "left_semi").select("*", *[_bin(f).alias(f"{f}_bin") for f in FIELDS])
    entries = F.array_compact(
        F.array(*[F.when((F.col(a) > 0) & (F.col(b) > 0), F.struct(F.lit(k).alias("combo"), F.col(f"{a}_bin").alias("x"), F.col(f"{b}_bin").alias("y"))) for k, (a, b) in enumerate(COMBINATIONS)])
    )
    cells = materialize(binned.select("class_id", "n", "grp", *FIELDS, F.explode(entries).alias("e")).select("class_id", "n", "grp", *FIELDS, "e.*"), "vantage-cells")
    total, distance = cells.count(), F.col("x") + F.col("y")
    home = F.floor(distance / SHARD_WIDTH).cast("int")
    visits = F.sequence(home, F.floor((distance + RADIUS) / SHARD_WIDTH).cast("int"))
    distinct_cells = cells.groupBy("grp", "combo", "x", "y").agg((F.sum("n") > 1).alias("several"))
    sharded = distinct_cells.select("*", home.alias("home"), F.explode(visits).alias("shard"))
    parts = max(shuffle_partitions(spark), total // CELLS_PER_TASK + 1)
    bucketed = sharded.withColumn("bucket", F.pmod(F.xxhash64("grp", "combo", "shard"), F.lit(8 * parts))).repartition(parts, "bucket")
    pairs = bucketed.groupBy("bucket").applyInPandas(_search, "grp string, combo int, xa int, ya int, xb int, yb int")

    def near(a: str, b: str) -> Column:
        """Exact check; a pair is taken from the first combination that both records have."""
        both = {f: (F.col(f"{a}.{f}") > 0) & (F.col(f"{b}.{f}") > 0) for f in FIELDS}
        # multiplied out, as 0.05 * 1100 is a hair above 55
        price = F.abs(F.col(f"{a}.price") - F.col(f"{b}.price")) * (1 / PRICE_SHARE) < F.greatest(f"{a}.price", f"{b}.price")
        ok = F.when(both["price"], price).otherwise(True)
        for f, span in (("m2", M2_SPAN), ("rooms", ROOMS_SPAN)):
            ok &= F.when(both[f], F.abs(F.col(f"{a}.{f}") - F.col(f"{b}.{f}")) <= span + 1e-9).otherwise(True)
        first = F.when(both["price"] & both["m2"], 0).when(both["price"] & both["rooms"], 1).otherwise(2)
        return ok & (F.col(f"{a}.combo") == first)

    a, b, p = cells.alias("a"), cells.alias("b"), pairs.alias("p")
    cell = lambda s: [F.col(f"{s}.grp") == F.col("p.grp"), F.col(f"{s}.combo") == F.col("p.combo"), F.col(f"{s}.x") == F.col(f"p.x{s}"), F.col(f"{s}.y") == F.col(f"p.y{s}")]
    # a cell that meets itself gives each of its pairs twice
    once = F.when((F.col("p.xa") == F.col("p.xb")) & (F.col("p.ya") == F.col("p.yb")), (F.col("a.class_id") < F.col("b.class_id")) | (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.n") > 1)).otherwise(True)
    found = p.join(a, cell("a")).join(b, cell("b")).where(once & near("a", "b"))
    swap = F.col("a.class_id") > F.col("b.class_id")
    side = lambda c, s, t: F.when(swap, F.col(f"{t}.{c}")).otherwise(F.col(f"{s}.{c}"))
    return found.select(side("class_id", "a", "b").alias("a"), side("n", "a", "b").alias("na"), side("class_id", "b", "a").alias("b"), side("n", "b", "a").alias("nb"))


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return _known(rows).join(classes, ["grp", *FIELDS]).select("row_id", "class_id", "n")


def similar_records(rows: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``row_id`` in the same ``grp`` whose known fields agree within tolerance, two at least.

    ``rows``: ``row_id`` (unique), ``grp``, ``price``, ``m2``, ``rooms``. Null, NaN, 0 and negative values are unknown
    and not compared; rows without a group pair with nothing. Repeated rows pair with each other. All pairs come from the
    shards and their trees. Rows with the same fingerprint are one entry there, so a group that holds a third of all rows
    is as many entries as it has fingerprints, and these are spread over its shards.
    """
    classes = materialize(record_classes(rows), "vantage-classes")
    pairs, members = similar_classes(classes).alias("p"), materialize(_members(rows, classes), "vantage-members")
    a, b = members.alias("a"), members.alias("b")
    every = pairs.join(a, F.col("p.a") == F.col("a.class_id")).join(b, F.col("p.b") == F.col("b.class_id"))
    return every.where((F.col("p.a") < F.col("p.b")) | (F.col("a.row_id") < F.col("b.row_id"))).select(F.least("a.row_id", "b.row_id").alias("row_id_a"), F.greatest("a.row_id", "b.row_id").alias("row_id_b"))


def record_links(rows: DataFrame) -> DataFrame:
    """``row_id, class_id, n_links``: one row per row with a group, the class of its exact copies (their smallest id) and
    with how many other rows it pairs. As ``similar_records``, but linear in the rows: copies aren't expanded."""
    classes = materialize(record_classes(rows), "vantage-classes")
    pairs = materialize(similar_classes(classes), "vantage-links")
    to_b = pairs.select(F.col("a").alias("class_id"), F.when(F.col("a") == F.col("b"), F.col("nb") - 1).otherwise(F.col("nb")).alias("k"))
    to_a = pairs.where("a < b").select(F.col("b").alias("class_id"), F.col("na").alias("k"))
    links = to_b.unionByName(to_a).groupBy("class_id").agg(F.sum("k").alias("n_links"))
    return _members(rows, classes).join(links, "class_id", "left").select("row_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
