"""Linking records of one object across sources, with three-valued place agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmill.functions.places import neighbourhoods_agree
from plotmill.functions.text import sets_conflict
from plotmill.operators.bands import Band, band_join, open_band_join
from plotmill.runtime import materialize

PRICE, SIZE, IDENTITY_PRICE = Band("price", share=0.05), Band("m2", span=3.0), Band("price", share=0.10)


def agree() -> Column:
    return neighbourhoods_agree(F.col("a.hood"), F.col("b.hood"))


def match_kind() -> Column:
    """``confirmed`` where the places agree, ``numeric`` where that is unknown but the known rooms are equal, else null."""
    same_rooms = (F.col("a.rooms") > 0) & (F.col("a.rooms") == F.col("b.rooms"))
    return F.when(agree(), "confirmed").when(agree().isNull() & F.coalesce(same_rooms, F.lit(False)), "numeric")


def closeness() -> Column:
    """Price gap and size gap, each in units of its tolerance; less is closer."""
    price = F.abs(F.col("a.price") - F.col("b.price")) / F.greatest("a.price", "b.price", F.lit(1.0)) / 0.05
    return price + F.abs(F.col("a.m2") - F.col("b.m2")) / 3


def cross_source_pairs(rows: DataFrame, row_id: str, block: list[str]) -> DataFrame:
    """Pairs ``a < b`` of different sources (``portal``) within price and size tolerance, in equal ``block`` columns, with
    their kind. ``rows`` has ``url, portal, price, m2, rooms, hood``; unknown prices and sizes pair with nothing; equal
    addresses and equal portals are no cross-source pair, null ones are unknown and equal nothing."""
    other = F.coalesce(F.col("a.url") != F.col("b.url"), F.lit(True)) & ~F.col("a.portal").eqNullSafe(F.col("b.portal"))
    pairs = band_join(rows, rows, [PRICE, SIZE], block, (F.col(f"a.{row_id}") < F.col(f"b.{row_id}")) & other)
    return pairs.select(F.col(f"a.{row_id}").alias("id_a"), F.col(f"b.{row_id}").alias("id_b"), match_kind().alias("kind")).where("kind is not null")


def best_match(candidates: DataFrame, candidate_id: str, pool: DataFrame, pool_id: str) -> DataFrame:
    """For each candidate the best row of the whole pool: confirmed before numeric, then the closest, then the smallest id.

    Whether the winner may be used is for the caller to test afterwards: filtering the pool first would pick a worse twin.
    """
    shape = ["price", "m2", "rooms", "hood"]
    # equal shapes match alike: one row each, so a shape that a third of the rows has costs one comparison
    wanted = candidates.select(*shape).distinct()
    offered = pool.groupBy(*shape).agg(F.min(pool_id).alias("match"))
    scored = band_join(offered, wanted, [PRICE, SIZE]).select(*[F.col(f"b.{c}").alias(c) for c in shape], F.struct(match_kind().alias("kind"), closeness().alias("gap"), F.col("a.match").alias("match")).alias("m")).where("m.kind is not null")
    best = scored.groupBy(*shape).agg(F.min("m").alias("m")).alias("s")
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in shape]
    return candidates.alias("c").join(best, on).select(F.col(f"c.{candidate_id}").alias("candidate"), "s.m.match", "s.m.kind", "s.m.gap")


def _known(c: str) -> Column:
    return F.coalesce((F.col(f"a.{c}") > 0) & (F.col(f"b.{c}") > 0), F.lit(False))


def _within(c: str, gap: Column, most: float) -> Column:
    """At most so far apart; unknown passes."""
    return ~_known(c) | (gap <= most)


def known_match(candidates: DataFrame, candidate_id: str, pool: DataFrame, pool_id: str) -> DataFrame:
    """As ``best_match``, with identity before numbers: equal unit codes, then a known title, confirmed, numeric.

    Both sides have ``price, m2, rooms, hood, codes, tokens`` (arrays of unit codes and of title words), candidates ``key``
    and the pool ``keys``, title keys. Different unit codes match nothing. A title needs sizes that agree, identity a price
    within 10 %, unknown ones pass; titles without a common word veto a numeric match. For closeness unknown is 0.
    """
    shape = ["price", "m2", "rooms", "hood", "codes", "tokens"]
    wanted = materialize(candidates.select(*shape, "key").distinct(), "match-wanted")
    offered = materialize(pool.select(*shape, "keys", F.col(pool_id).alias("match")), "match-offered")
    gap = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    priced = _within("price", gap("price") / F.greatest("a.price", "b.price"), 0.10)
    sized = _within("m2", gap("m2"), 3.0) & _within("rooms", gap("rooms"), 0.5)
    value = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(0.0)
    price_a, price_b = value("a.price"), value("b.price")
    close = F.abs(price_a - price_b) / F.greatest(price_a, price_b, F.lit(1.0)) / 0.05 + F.abs(value("a.m2") - value("b.m2")) / 3
    # each kind of pair looks at some fields only; rows that are equal in these are one, on both sides
    one = lambda df, *cols: df.groupBy(*cols).agg(F.min("match").alias("match"))
    coded = (F.size("codes") > 0).alias("coded")
    asked = [*shape, "key"]

    def best(pairs: DataFrame, kind: Column, rank: Column, by: list[str]) -> DataFrame:
        m = F.struct(rank.alias("rank"), close.alias("gap"), F.col("a.match").alias("match"), kind.alias("kind"))
        return pairs.groupBy(*[F.col(f"b.{c}").alias(c) for c in by]).agg(F.min(m).alias("m"))

    def back(found: DataFrame, of: DataFrame) -> DataFrame:
        """The best of what is equal in the fields looked at, for each of the wanted rows."""
        by = [c for c in found.columns if c != "m"]
        on = [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
        return of.alias("w").join(found.alias("f"), on).select(*[F.col(f"w.{c}") for c in asked], "f.m")

    on = F.explode("codes").alias("code")
    unit = ["price", "m2", "code"]
    by_code = open_band_join(one(offered.select("price", "m2", on, "match"), *unit), wanted.select("price", "m2", on).distinct(), [IDENTITY_PRICE], ["code"], priced)
    title = ["price", "m2", "rooms", "coded", "key"]
    shown = one(offered.select("price", "m2", "rooms", coded, F.explode("keys").alias("key"), "match"), *title)
    titled = wanted.where("key <> ''").select(*asked, coded)
    by_title = open_band_join(shown, titled.select(*title).distinct(), [IDENTITY_PRICE, SIZE], ["key"], priced & sized & ~(F.col("a.coded") & F.col("b.coded")))
    # a pair that is also known by its code or title is there with a lower rank, so it needn't be left out here
    near = band_join(one(offered, *shape), wanted.select(*shape).distinct(), [PRICE, SIZE], residue=~sets_conflict(F.col("a.codes"), F.col("b.codes")))
    kinds = near.withColumn("kind", match_kind()).where(F.col("kind").isNotNull() & ~((F.col("kind") == "numeric") & sets_conflict(F.col("a.tokens"), F.col("b.tokens"))))
    found = [
        back(best(by_code, F.lit("unit"), F.lit(-2), unit), wanted.withColumn("code", F.explode("codes"))),
        back(best(by_title, F.lit("title"), F.lit(-1), title), titled),
        back(best(kinds, F.col("kind"), F.when(F.col("kind") == "confirmed", 0).otherwise(1), shape), wanted),
    ]
    winner = reduce(DataFrame.unionByName, found).groupBy(*asked).agg(F.min("m").alias("m")).alias("s")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in asked]
    return candidates.alias("c").join(winner, same).select(F.col(f"c.{candidate_id}").alias("candidate"), "s.m.match", "s.m.kind", "s.m.gap")


def near_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``portal_a, portal_b, n``: pairs within price and size tolerance with equal rooms, counted per pair of portals.

    Equal shapes are one row with their number on either side, and a pair of shapes counts as the product.
    """
    shape = ["portal", "price", "m2", "rooms"]
    left, right = (df.groupBy(*shape).agg(F.count(F.lit(1)).alias("n")) for df in (a, b))
    return band_join(left, right, [PRICE, SIZE], ["rooms"]).groupBy(F.col("a.portal").alias("portal_a"), F.col("b.portal").alias("portal_b")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("n"))


def footprint(targets: DataFrame, target_id: str, pool: DataFrame) -> DataFrame:
    """``target, url``: adverts of the pool that show the target's object: sizes within 0.5, equal rooms where both are
    known, places not known to differ, no swap, and either the same squashed title of more than eight characters or a
    price within 2 % of the target's where the places agree. Two equi-joins: on the title, and on bands of size and price."""
    rooms = F.coalesce((F.col("a.rooms") == F.col("b.rooms")) | (F.col("a.rooms") <= 0) | (F.col("b.rooms") <= 0), F.lit(True))
    place = F.coalesce(agree(), F.lit(True))
    swap = F.coalesce(F.col("a.title").rlike("(?i)tausch"), F.lit(False))
    shared = rooms & place & ~swap & (F.col("a.url") != F.col("b.url"))
    picked = lambda df: df.select(F.col(f"b.{target_id}").alias("target"), F.col("a.url").alias("url"))
    long = lambda df: df.where(F.length("squashed") > 8)
    titled = band_join(long(pool), long(targets), [Band("m2", span=0.5)], ["squashed"], shared)
    priced = band_join(pool, targets, [Band("m2", span=0.5), PRICE], [], shared & agree() & (F.abs(F.col("a.price") - F.col("b.price")) / F.col("b.price") <= 0.02))
    return picked(titled).unionByName(picked(priced)).distinct()
