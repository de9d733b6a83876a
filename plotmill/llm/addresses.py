"""Which address records denote the same building: parsed addresses, compared within town, number and letter.

Addresses are parsed into street, house number, letter and locality; number and letter must be equal (they are never
misspelt), and the locality is resolved to towns through the gazetteer, whose size is checked. Equal addresses are
reduced to one entry. All entries with the same town, number and letter are compared by a transposition-tolerant edit
distance, after arrays of their letters have left out nearly all pairs. A large block is cut into tiles, each compared with
itself and every other, so its comparisons are spread over tasks; what a block does in one task is to sort and to join
the links found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotmill.runtime import materialize, shuffle_partitions

#: Blocks of up to one entry more are compared pair by pair, larger ones by arrays; the links found join the same streets.
WINDOW = 64
#: Entries of a block per tile; two tiles are compared at a time.
SEGMENT = 8192
#: Entries that one Python task compares.
ENTRIES_PER_TASK = 20_000
#: Names of so many letters may differ by two edits.
LONG_NAME = 8
#: The gazetteer goes to every executor; a larger one is refused.
GAZETTEER_ROWS = 200_000

#: Written forms of one and the same street word.
STREET_WORDS = [
    (r"str(?:asse|\.|\b)", "strasse"), (r"pl(?:atz|\.)", "platz"), (r"ch(?:aussee|\.)", "chaussee"), (r"\ba\. ?d\.", "an der"), (r"\ba\. ", "am "),
]
_FORM = re.compile(r"^(am|an ?der|an ?den|zum|zur|im|in ?der|auf ?der|neü|neür|neüs|alte|alter|altes)?\s*(.*?)\s*(strasse|allee|ring|gasse|ufer|platz|weg|chaussee|damm|steig|pfad|markt)?$")
_NUMBER = re.compile(r"^(.*?[^\W\d_][.)]?)(?:[ ,]+(?:haus)?(?:nummer|nr|no)\b\.?)? *([0-9]{1,4}) ?([a-z])?(?![\w])(.*)$")
_PLZ = re.compile(r"\(?(?<![0-9])(?:\bd ?- ?)?([0-9]{4,6})(?![0-9])\)?")
_PREFIX = re.compile(r"^\s*(?:[^\W\d_]+\s*:|ca\.)\s*")
_NOT_STREET = re.compile(r"^\s*(?:whg|wohnung|app|apartment|og|eg|stock|etage|haus|nr|top|zimmer|we)\b")
_SEPARATORS = re.compile(r"[,|;\n]| in (?=[^\W\d_])")
_SPACES = re.compile(r"[\s   ]+")


def fold(text: str) -> str:
    """Lower case, one space at most, umlauts and their two-letter spellings as one letter."""
    s = _SPACES.sub(" ", unicodedata.normalize("NFC", text).lower())
    return s.replace("ae", "ä").replace("oe", "ö").replace("ue", "ü").replace("ß", "ss").strip()


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with transpositions of neighbours (optimal string alignment), or ``limit + 1`` if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    if limit == 1 and max(len(a), len(b)) > 2:
        return 2  # more than one edit, as both ends of what is left differ
    before, row = [], list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        last2, before, row = before, row, [x]
        for y in range(1, len(b) + 1):
            d = min(before[y] + 1, row[y - 1] + 1, before[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, last2[y - 2] + 1)
            row.append(d)
        if min(row) > limit and min(before) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def spelt_out(folded: str) -> str:
    """The two-letter spelling of folded umlauts; a slip of the pen may hit either spelling."""
    return folded.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")


def distance(a: str, b: str, limit: int) -> int:
    """The smaller edit distance of two folded names, umlauts taken as one letter or as two."""
    d = osa(a, b, limit)
    return d if d <= 1 else min(d, osa(spelt_out(a), spelt_out(b), limit))


def letter_set(name: str) -> int:
    """The letters of a name as bits. One edit changes two of them at most, so names whose sets differ by more than twice
    the limit needn't be compared."""
    bits = 0
    for c in set(name):
        bits |= 1 << (ord(c) & 63)
    return bits


class Name:
    """A folded name with what comparing it needs."""

    def __init__(self, folded: str) -> None:
        self.folded, self.spelt = folded, spelt_out(folded)
        self.bits, self.spelt_bits = letter_set(self.folded), letter_set(self.spelt)

    def near(self, other: Name, limit: int) -> int:
        """``distance``, or more than ``limit``."""
        if (self.bits ^ other.bits).bit_count() > 2 * limit and (self.spelt_bits ^ other.spelt_bits).bit_count() > 2 * limit:
            return limit + 1
        return distance(self.folded, other.folded, limit)


class Gazetteer:
    """Towns by full name, short name, hood and postcode, for resolving a locality text."""

    def __init__(self, rows: list[tuple[str | None, str | None, str | None]]) -> None:
        self.names: dict[str, set[str]] = {}
        self.plz: dict[str, set[str]] = {}
        for plz, hood, town in rows:
            if not town:
                continue
            t = fold(town)
            for name in self._forms(t):
                self.names.setdefault(name, set()).add(t)
            if hood:
                self.names.setdefault(letters(fold(hood)), set()).add(t)
            if plz:
                self.plz.setdefault(plz.strip(), set()).add(t)
        self.near = [Name(n) for n in self.names]
        self.cache: dict[tuple[str, str], tuple[str, ...]] = {}

    @staticmethod
    def _forms(town: str) -> set[str]:
        m = re.match(r"^(.+?) (an der|an den|am|im|in der|ob der|bei) (.+)$", town)
        if not m:
            return {letters(town)}
        base, _, tail = m.groups()
        short = "".join(w[0] for w in m[2].split())
        return {letters(x) for x in (town, base, base + tail, f"{base}{short}{tail}")}

    def towns(self, locality: str, plz: str) -> tuple[str, ...]:
        """The towns that a locality text and a postcode, both possibly misspelt, can mean; empty if nothing fits."""
        key = (locality, plz)
        if key not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[key] = tuple(sorted(self._towns(locality, plz)))
        return self.cache[key]

    def _towns(self, locality: str, plz: str) -> set[str]:
        found = self._by_name(locality)
        exact = self.plz.get(plz, set())
        if found:
            if len(found) > 1:
                return found & exact or found & self._near_plz(plz) or found & self._near_name(self._parts(locality)[0]) or found
            return found
        return exact or self._near_plz(plz)

    def _near_plz(self, plz: str) -> set[str]:
        if not plz:
            return set()
        return set().union(*(t for p, t in self.plz.items() if osa(p, plz, 1) <= 1))

    @staticmethod
    def _parts(locality: str) -> tuple[list[str], list[str]]:
        """The parts of a text, and the pieces of those with a hyphen or slash, as letters only."""
        whole = [w for w in (letters(p) for p in re.split(r"[,|;()\n]| - ", locality)) if w]
        return whole, [w for p in re.split(r"[,|;()\n]", locality) if "-" in p or "/" in p for w in map(letters, re.split(r"[-/]", p)) if w]

    def _near_name(self, parts: list[str]) -> set[str]:
        """Towns of the names nearest to the parts, within one edit, or two for long parts."""
        towns: set[str] = set()
        for w in parts:
            if len(w) >= 4 and w not in self.names:
                limit = 2 if len(w) >= 9 else 1
                own = Name(w)
                near = {n.folded: d for n in self.near if (d := own.near(n, limit)) <= limit}
                towns |= set().union(*(self.names[n] for n, d in near.items() if d == min(near.values())))
        return towns

    def _by_name(self, locality: str) -> set[str]:
        """Intersection of what the parts of the text mean; exact names before misspelt ones, longer before shorter."""
        whole, halves = self._parts(locality)
        evidence = [self.names[w] for w in whole + halves if w in self.names]
        if not evidence:
            evidence = [t for w in whole + halves if (t := self._near_name([w]))]
        if not evidence:
            return set()
        common = set.intersection(*evidence)
        return common or min(evidence, key=len)


def letters(s: str) -> str:
    return "".join(c for c in s if c.isalpha())


def parse(location: str | None, gazetteer: Gazetteer) -> tuple[str, str, tuple[str, ...]] | None:
    """Street, number with letter, and possible towns of a location; None without a house number.

    Floors, wings and flat numbers are left out. If no town is recognised, the locality text itself, or else the
    postcode, stands for one.
    """
    if not location or not any(c.isdigit() for c in location):
        return None
    s = fold(location)
    while m := _PREFIX.match(s):
        s = s[m.end() :]
    codes = [m for m in _PLZ.finditer(s) if len(m[1]) == 5 or m.end() - m.start() > len(m[1])] or [m for m in _PLZ.finditer(s) if m[1] in gazetteer.plz or len(m[1]) > 4]
    if not codes:
        # a postcode with a digit missing stands before or after a separator, where no house number can stand
        codes = [m for m in _PLZ.finditer(s) if len(m[1]) == 4 and (not s[: m.start()].strip() or s[: m.start()].rstrip()[-1] in ",|;")]
    plz = codes[0][1] if codes else ""
    for m in reversed(codes):
        s = f"{s[: m.start()]} {s[m.end() :]}"
    street = number = None
    rest: list[str] = []
    for part in _SEPARATORS.split(s):
        part = part.strip()
        m = None if number or _NOT_STREET.match(part) else _NUMBER.match(part)
        if m:
            street, number = m[1], m[2].lstrip("0") + (m[3] or "")
        elif part:
            rest.append(part)
    if not number or number[0].isalpha():
        return None
    for pattern, word in STREET_WORDS:
        street = re.sub(pattern, word, street + " ").strip()
    form, stem, kind = (x or "" for x in _FORM.match(re.sub(r"[-\s]+", " ", street)).groups())
    towns = gazetteer.towns(",".join(rest), plz) or (f"?{letters(''.join(rest)) or plz}",)
    return f"{form.replace(' ', '')}|{letters(stem)}|{kind}", number, towns


def parsed_addresses(rows: DataFrame, gazetteer: DataFrame, row_id: str, location: str) -> DataFrame:
    """``row_id, street, number, towns`` of the rows with a house number."""
    known = gazetteer.select("plz", "hood", "town").limit(GAZETTEER_ROWS + 1).collect()
    if len(known) > GAZETTEER_ROWS:
        raise ValueError(f"the gazetteer has more than {GAZETTEER_ROWS} rows")
    shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in known])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Gazetteer(shared.value)
        for pdf in batches:
            out = [(i, *p) for i, p in zip(pdf["id"], (parse(x, g) for x in pdf["location"]), strict=True) if p]
            yield pd.DataFrame({"row_id": [o[0] for o in out], "street": [o[1] for o in out], "number": [o[2] for o in out], "towns": [list(o[3]) for o in out]}).astype({"row_id": "int64"})

    picked = rows.where(F.col(row_id).isNotNull() & F.col(location).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), F.col(location).cast("string").alias("location"))
    return picked.mapInPandas(run, "row_id bigint, street string, number string, towns array<string>")


class Street:
    """Form, name and kind of a street, as ``parse`` gives them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.form, self.stem, self.kind = text.split("|")
        self.name, self.whole = Name(self.stem), Name(self.form + self.stem + self.kind)

    def same(self, other: Street) -> bool:
        """Whether two spellings link. Forms must be equal where both streets have a recognised one; else the whole names
        are compared. One edit links, two edits link long names, but not a name and its form in ``-er``."""
        a, b = (self.name, other.name) if self.form == other.form and self.kind == other.kind else (self.whole, other.whole)
        if a is self.whole and (self.form and other.form and self.form != other.form or self.kind and other.kind and self.kind != other.kind):
            return False
        short, long = sorted((a.folded, b.folded), key=len)
        limit = 2 if len(short) >= LONG_NAME and long != short + "er" else 1
        return a.near(b, limit) <= limit


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def root(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: str, b: str) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def pair_links(streets: list[str]) -> list[tuple[str, str]]:
    """Links that join the streets of a small block, a forest."""
    classes, links, parsed = Classes(), [], [Street(s) for s in streets]
    for i, a in enumerate(parsed):
        bits, spelt, size = a.whole.bits, a.whole.spelt_bits, len(a.whole.folded)
        for b in parsed[i + 1 :]:
            # two edits change four letters of the set at most, forms and kinds are equal or part of what is compared
            if (bits ^ b.whole.bits).bit_count() > 4 and (spelt ^ b.whole.spelt_bits).bit_count() > 4 or abs(size - len(b.whole.folded)) > 4:
                continue
            if classes.root(a.text) != classes.root(b.text) and a.same(b):
                classes.join(a.text, b.text)
                links.append((a.text, b.text))
    return links


def letter_counts(name: str) -> int:
    """Which letters a name has once and which twice, as bits. One edit changes two of them at most."""
    once = twice = 0
    for c in name:
        bit = 1 << (ord(c) & 31)
        twice |= once & bit
        once |= bit
    return once | twice << 32


def tile_links(streets: list[str], own: int) -> list[tuple[str, str]]:
    """Links that join the first ``own`` streets with those that follow, or with each other if none do, a forest."""
    parsed, links = [Street(s) for s in streets], []
    folded, spelt = (np.array([letter_counts(getattr(p.whole, k)) for p in parsed], np.uint64) for k in ("folded", "spelt"))
    label = np.arange(len(streets))
    for i, a in enumerate(parsed[:own]):
        start = i + 1 if own == len(streets) else own
        near = (np.bitwise_count(folded[start:] ^ folded[i]) <= 4) | (np.bitwise_count(spelt[start:] ^ spelt[i]) <= 4)
        for j in (np.flatnonzero(near & (label[start:] != label[i])) + start).tolist():
            if label[j] != label[i] and a.same(parsed[j]):
                label[label == label[j]] = label[i]
                links.append((a.text, parsed[j].text))
    return links


_BLOCK = ["town", "number"]


def street_links(entries: DataFrame, parts: int, window: int = WINDOW) -> DataFrame:
    """``town, number, a, b``: links between the streets of a block. ``entries`` has distinct ``town, number, street``.
    All pairs are compared, so the classes that the links make don't depend on the block's size."""
    block = Window.partitionBy(*_BLOCK)
    sized = entries.select(*_BLOCK, "street", F.count(F.lit(1)).over(block).alias("size"), (F.row_number().over(block.orderBy("street")) - 1).alias("at")).where("size > 1")
    # each tile meets itself and every other
    home, tiles = F.floor(F.col("at") / SEGMENT), F.floor((F.col("size") - 1) / SEGMENT)
    met = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), tiles), lambda k: F.struct(F.least(home, k).alias("low"), F.greatest(home, k).alias("high")))).alias("z")
    placed = sized.select(*_BLOCK, "street", home.alias("home"), met).select(*_BLOCK, "street", "home", "z.*")
    bucketed = placed.withColumn("bucket", F.pmod(F.xxhash64(*_BLOCK, "low", "high"), F.lit(8 * parts))).repartition(parts, "bucket")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (town, number, low, _), part in pdf.sort_values(["home", "street"]).groupby(["town", "number", "low", "high"], sort=False):
            streets = part["street"].tolist()
            links = tile_links(streets, int((part["home"] == low).sum())) if len(streets) > window + 1 else pair_links(streets)
            out += [(town, number, a, b) for a, b in links]
        return pd.DataFrame(out, columns=["town", "number", "a", "b"])

    return bucketed.groupBy("bucket").applyInPandas(compare, "town string, number string, a string, b string")


def named_streets(entries: DataFrame, parts: int, window: int = WINDOW) -> DataFrame:
    """``town, number, street, sure, name``: for each street of a block the name of its class, the one with most rows."""
    both = entries.select(*_BLOCK, F.col("street").alias("a"), F.lit(None).cast("string").alias("b"), "sure", "g").unionByName(street_links(entries, parts, window), allowMissingColumns=True)
    bucketed = both.withColumn("bucket", F.pmod(F.xxhash64(*_BLOCK), F.lit(8 * parts))).repartition(parts, "bucket")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        links = pdf["b"].notna()
        streets, classes = pdf[~links], Classes()
        key = lambda t, n, s: f"{t}\0{n}\0{s}"
        for t, n, a, b in pdf.loc[links, ["town", "number", "a", "b"]].itertuples(index=False):
            classes.join(key(t, n, a), key(t, n, b))
        rows = list(streets[["town", "number", "a", "sure", "g"]].itertuples(index=False, name=None))
        best: dict[str, tuple] = {}
        for t, n, s, sure, g in rows:
            r, rank = classes.root(key(t, n, s)), (-sure, -g, s)
            best[r] = min(best.get(r, rank), rank)
        return pd.DataFrame([(t, n, s, sure, best[classes.root(key(t, n, s))][2]) for t, n, s, sure, _ in rows], columns=["town", "number", "street", "sure", "name"]).astype({"sure": "int64"})

    return bucketed.groupBy("bucket").applyInPandas(cluster, "town string, number string, street string, sure bigint, name string")


def buildings(rows: DataFrame, gazetteer: DataFrame, row_id: str = "addition_id", location: str = "location") -> DataFrame:
    """``row_id, building`` of the rows with a house number; equal ``building`` = same street, number, letter and town.

    Null, empty and number-less locations give no row. Repeated rows each give one. A locality that fits several towns
    (a shared short name, a misspelt postcode) is given the town where the building, or else the street, has most rows
    whose town is certain.
    """
    spark = rows.sparkSession
    parsed = materialize(parsed_addresses(rows, gazetteer, row_id, location), "addresses")
    town = F.explode("towns").alias("town")
    entries = parsed.select(town, "number", "street", (F.size("towns") == 1).cast("int").alias("sure")).groupBy("town", "number", "street").agg(F.sum("sure").alias("sure"))
    common = parsed.groupBy("street").agg(F.count(F.lit(1)).alias("g"))
    entries = materialize(entries.join(common, "street"), "address-entries")
    # a fixed number of partitions, as adaptive execution judges by bytes, not by the work in Python; several buckets
    # each, as hashing few buckets would leave partitions empty
    parts = max(shuffle_partitions(spark), entries.count() // ENTRIES_PER_TASK + 1)
    named = materialize(named_streets(entries, parts), "address-names")
    house = named.groupBy("town", "number", "name").agg(F.sum("sure").alias("house_rows"))
    road = named.groupBy("town", "name").agg(F.sum("sure").alias("road_rows"))
    # names of ambiguous entries only need the counts; certain ones keep their single town
    choices = named.join(house, ["town", "number", "name"]).join(road, ["town", "name"])
    key = F.concat_ws("|", "town", "name", "number").alias("building")
    certain = parsed.where(F.size("towns") == 1).select("row_id", F.element_at("towns", 1).alias("town"), "number", "street")
    sure_rows = certain.join(named, ["town", "number", "street"]).select("row_id", key)
    open_rows = parsed.where(F.size("towns") > 1).select("row_id", town, "number", "street").join(choices, ["town", "number", "street"])
    picked = open_rows.groupBy("row_id").agg(F.max_by(F.struct("town", "name", "number"), F.struct("house_rows", "road_rows", "town")).alias("b"))
    return sure_rows.unionByName(picked.select("row_id", F.concat_ws("|", "b.town", "b.name", "b.number").alias("building")))


def building_classes(rows: DataFrame, gazetteer: DataFrame, row_id: str = "addition_id", location: str = "location") -> DataFrame:
    """One row per row with a house number: ``row_id``, the smallest id at its building, and how many rows are there."""
    placed = materialize(buildings(rows, gazetteer, row_id, location), "buildings")
    sizes = placed.groupBy("building").agg(F.min("row_id").alias("building_id"), F.count(F.lit(1)).alias("n_rows"))
    return placed.join(sizes, "building").select(F.col("row_id").alias(row_id), "building_id", "n_rows")


def same_building_pairs(rows: DataFrame, gazetteer: DataFrame, row_id: str = "addition_id", location: str = "location") -> DataFrame:
    """All pairs of rows at one building, the smaller id first. Every pair is wanted, so the output bounds the work."""
    placed = materialize(buildings(rows, gazetteer, row_id, location), "buildings")
    a, b = placed.alias("a"), placed.alias("b")
    return a.join(b, (F.col("a.building") == F.col("b.building")) & (F.col("a.row_id") < F.col("b.row_id"))).select(F.col("a.row_id").alias(f"{row_id}_a"), F.col("b.row_id").alias(f"{row_id}_b"))
