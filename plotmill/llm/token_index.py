"""An incremental inverted index of rare-token prefixes, for checking new batches against everything accepted before.

A record is a set of tokens. Tokens are ordered from rare to frequent by an order that is frozen when the index is
built; tokens unknown then count as rare. Two sets with Jaccard similarity of at least t share a token among the first
``n - ceil(t * n) + 1`` of each, so only these prefixes get postings. The postings are a table bucketed by token and
sorted in each bucket: prefixes are shuffled to the buckets, the postings stay where they are. All batches that are
pending together probe it in one pass, and a few tokens only read their buckets. What is accepted is appended as small
tables, which later batches probe too, until compaction moves them into the buckets. The index is kept in a folder and
opened again by later runs, so history is read when it is built and never again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.runtime import materialize, new_path, shuffle_partitions

#: Where the advert code stands in an address of each portal, after lower-casing and percent-decoding.
ADVERT_PATTERNS = {
    "wohnkompass.example": "/expose/([0-9]{11})(?![0-9a-z])",
    "mietradar.example": "/angebot/(?:[^/?#;]*-)?([0-9a-f]{11})(?![0-9a-z])",
    "kiezmarkt.example": "/s-anzeige/[^/?#]*/([0-9]{11})-203-[0-9]{3}",
    "nestfinder.example": "/objekt[^?#]*[?](?:[^#]*&)?id=([0-9]{11})(?![0-9a-z])",
    "havelquartier.example": "/wohnungen[^#]*#we-([0-9]{11})(?![0-9a-z])",
    "sparhaus.example": "/angebote/[^/?#]*/fio-([0-9]{11})\\.html",
    "stadtbau.example": "/mieten/[^/?#]*/([0-9]{11})(?![0-9a-z])",
    "auktiva.example": "/zvg/[^/?#]*/([0-9]{11})(?![0-9a-z])",
}


def advert_tokens(rows: DataFrame, keep: list[str], url: str = "url") -> DataFrame:
    """``keep`` columns and ``tokens``: the two tokens of an advert's address, portal site and advert code; null for null
    or blank addresses.

    Letter case, scheme, user, port, ``www.``, ``m.`` and other subdomains, doubled slashes, percent-encoding, query,
    fragment and session parameters don't matter. An address without a code of a known form counts by its site and its
    path, without query, fragment and closing slashes. Steps are separate projections, so no step is evaluated twice.
    """
    raw, u, host, site = (F.col(c) for c in ("__raw", "__u", "__host", "__site"))
    bare = rows.select(*keep, F.regexp_replace(F.lower(url), "^[\\s<\"']+|[\\s>\"']+\\z", "").alias("__raw"))
    decoded = F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2b"))), raw)).otherwise(raw)
    plain = bare.select(*keep, F.regexp_replace(decoded, "(?<!:)/{2,}", "/").alias("__u"))
    hosts = plain.select(*keep, "__u", F.rtrim(F.regexp_extract(u, "^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(".")).alias("__host"))
    sites = hosts.select(*keep, "__u", F.concat(F.lit("."), F.substring_index(host, ".", -2)).alias("__site"))
    code = F.coalesce(*[F.when(site == f".{name}", F.regexp_extract(u, pattern, 1)) for name, pattern in ADVERT_PATTERNS.items()], F.lit(""))
    codes = sites.select(*keep, "__u", "__site", code.alias("__code"))
    path = F.regexp_replace(F.regexp_replace(u, "^(?:[a-z][a-z0-9+.-]*:)?(?://)?[^/?#]*", ""), "[?#;].*\\z|/+\\z", "")
    second = F.when(F.col("__code") != "", F.concat(F.lit("code:"), "__code")).otherwise(F.concat(F.lit("path:"), path))
    return codes.select(*keep, F.when(u != "", F.array(F.concat(F.lit("site:"), F.substring(site, 2, 300)), second)).alias("tokens"))


#: A probe of so few tokens names them to the scan, which then reads only their buckets.
FEW_TOKENS = 64
#: Appended tables after which they are moved into the buckets.
COMPACT_AFTER = 16

_POSTINGS = ("tok", "n", "tokens", "since", "entry_id")
_SCHEMA = "tok bigint, n int, tokens array<string>, since date, entry_id bigint"


class TokenIndex:
    """Postings ``(tok, n, tokens, since, entry_id)``: hash of a prefix token, size and tokens of the set, and where it
    came from. ``entry_id`` is null for history. In the folder ``path``: the frequent tokens, the bucketed table, appended
    tables, and ``index.json``, which names what counts; it is replaced last, so a crash leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.path, self.state = spark, path, state
        self.frequent = spark.read.schema("token string, df bigint").parquet(f"{path}/frequent")
        self.threshold, self.buckets = state["threshold"], state["buckets"]
        self._table: str | None = None

    @classmethod
    def build(cls, records: DataFrame, threshold: float = 1.0, buckets: int | None = None, path: str | None = None) -> TokenIndex:
        """Index ``records`` (``tokens array<string>``, ``since date``) in the new folder ``path``, by default one below
        the shared folder that goes with the driver. Equal sets are one record; null sets are left out."""
        spark, path = records.sparkSession, path or new_path(records.sparkSession, "token-index")
        # no filter on tokens here: it would be pushed below their expressions and evaluate them twice; exploding drops null
        sets = materialize(records.groupBy("tokens").agg(F.min("since").alias("since")), "index-sets")
        counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        counts.write.parquet(f"{path}/frequent")
        index = cls(spark, path, {"threshold": threshold, "buckets": buckets or max(shuffle_partitions(spark), 8), "base": "base-0", "adds": []})
        index._write_base(index._prefixes(sets.withColumns({"entry_id": F.lit(None).cast("bigint"), "batch_no": F.lit(None).cast("int")})), "base-0")
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenIndex:
        """The index that an earlier run left in ``path``."""
        return cls(spark, path, json.loads(spark.read.text(f"{path}/index.json", wholetext=True).first()[0]))

    def close(self) -> None:
        """Forget the catalogue's entry; the files stay."""
        if self._table:
            self.spark.sql(f"drop table if exists {self._table}")
            self._table = None

    def _save(self) -> None:
        jvm = self.spark.sparkContext._jvm
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in ("_index.new", "index.json"))
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        fs.delete(old, False)
        fs.rename(new, old)

    def _prefixes(self, sets: DataFrame) -> DataFrame:
        """One row per set and token of its prefix; ``sets`` has distinct ``batch_no, tokens``, ``since`` and ``entry_id``."""
        ranked = (
            sets.select("batch_no", "tokens", "since", "entry_id", F.explode("tokens").alias("token"))
            .join(self.frequent, "token", "left")
            .groupBy("batch_no", "tokens")
            .agg(F.min("since").alias("since"), F.min("entry_id").alias("entry_id"), F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), F.xxhash64("token").alias("tok")))).alias("ranked"))
        )
        n = F.size("ranked")
        keep = (n - F.ceil(n * F.lit(self.threshold) - 1e-9) + 1).cast("int")
        return ranked.select("batch_no", F.explode(F.slice("ranked", F.lit(1), keep)).alias("r"), n.alias("n"), "tokens", "since", "entry_id").select("batch_no", "r.tok", "n", "tokens", "since", "entry_id")

    def stage(self, rows: DataFrame) -> DataFrame:
        """Prefixes of pending rows (``entry_id, batch_no, tokens, since``), written by batch. The order of tokens is
        frozen, so they don't depend on what is accepted meanwhile. Rows of equal sets are reduced to the first one of
        their batch before the shuffle, so a hot set is one row."""
        sets = rows.groupBy("batch_no", "tokens").agg(F.min("entry_id").alias("entry_id"), F.min("since").alias("since"))
        return materialize(self._prefixes(sets), "batch-prefixes", "batch_no")

    def _write_base(self, postings: DataFrame, name: str) -> None:
        self.close()
        self._table = f"token_index_{uuid.uuid4().hex}"
        writer = postings.select(*_POSTINGS).repartition(self.buckets, "tok").write.format("parquet")
        writer.bucketBy(self.buckets, "tok").sortBy("tok").option("path", f"{self.path}/{name}").saveAsTable(self._table)

    def base(self) -> DataFrame:
        """The bucketed postings."""
        if self._table is None:
            self._table = f"token_index_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self._table} ({_SCHEMA}) using parquet clustered by (tok) sorted by (tok) into {self.buckets} buckets location '{self.path}/{self.state['base']}'")
        return self.spark.table(self._table)

    def _appended(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])

    def _append(self, postings: DataFrame) -> str:
        name = f"add-{uuid.uuid4().hex}"
        postings.select(*_POSTINGS).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.state["adds"].append(name)
        return name

    def _similar(self, a: str, b: str) -> Column:
        t = F.lit(self.threshold)
        lengths = (F.col(f"{a}.n") >= t * F.col(f"{b}.n") - 1e-9) & (F.col(f"{b}.n") >= t * F.col(f"{a}.n") - 1e-9)
        overlap = F.size(F.array_intersect(f"{a}.tokens", f"{b}.tokens"))
        return lengths & (overlap * (1 + t) >= t * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-9)

    def _probe(self, prefixes: DataFrame, postings: DataFrame) -> DataFrame:
        """``batch_no, tokens`` of the sets that are similar to one of the postings."""
        b, i = prefixes.hint("shuffle_hash").alias("b"), postings.alias("i")
        return i.join(b, F.col("i.tok") == F.col("b.tok")).where(self._similar("b", "i")).select("b.batch_no", "b.tokens")

    def accept(self, prefixes: DataFrame) -> None:
        """Append the sets of staged batches that are new: similar to no set in the index, to no set accepted from an
        earlier batch, and to no set of their own batch with a smaller ``entry_id``.

        The index is probed once for all batches. Among the batches themselves, equal sets (threshold 1) need one more
        pass; similar ones are taken batch after batch, each probing what the ones before it appended."""
        few = prefixes.select("tok").distinct().limit(FEW_TOKENS + 1).collect()
        base = self.base() if len(few) > FEW_TOKENS else self.base().where(F.col("tok").isin([r.tok for r in few]))
        known = self._probe(prefixes, base)
        if self.state["adds"]:
            known = known.unionByName(self._probe(prefixes, self._appended(self.state["adds"])))
        fresh = prefixes.join(known, ["batch_no", "tokens"], "left_anti")
        if self.threshold >= 1:
            first = F.min(F.struct("batch_no", "entry_id", "since", "n")).alias("f")
            self._append(fresh.groupBy("tok", "tokens").agg(first).select("tok", "tokens", "f.n", "f.since", "f.entry_id"))
        else:
            fresh, mine = materialize(fresh, "batch-fresh", "batch_no"), []
            for (batch,) in fresh.select("batch_no").distinct().orderBy("batch_no").collect():
                own = fresh.where(F.col("batch_no") == batch)
                whole = prefixes.where(F.col("batch_no") == batch)
                e, b = whole.alias("e"), own.alias("b")
                seen = e.join(b, (F.col("e.tok") == F.col("b.tok")) & (F.col("e.entry_id") < F.col("b.entry_id"))).where(self._similar("b", "e")).select("b.batch_no", "b.tokens")
                if mine:
                    seen = seen.unionByName(self._probe(own, self._appended(mine)))
                mine.append(self._append(own.join(seen, ["batch_no", "tokens"], "left_anti")))
        if len(self.state["adds"]) > COMPACT_AFTER:
            self.compact()
        self._save()

    def compact(self) -> None:
        """Move what was appended into the buckets. ``accepted`` then no longer tells it from other postings of rows."""
        name = f"base-{uuid.uuid4().hex}"
        self._write_base(reduce(DataFrame.unionByName, [self.base(), self._appended(self.state["adds"])]), name)
        self.state |= {"base": name, "adds": []}

    def accepted(self) -> DataFrame:
        """``entry_id`` of all rows accepted since the index was built."""
        rows = self._appended(self.state["adds"])
        if self.state["base"] != "base-0":
            rows = rows.unionByName(self.base())
        return rows.where(F.col("entry_id").isNotNull()).select("entry_id").distinct()


def known_rows(history: DataFrame, inbox: DataFrame, threshold: float = 1.0, index_path: str | None = None) -> DataFrame:
    """``entry_id`` of the inbox rows that bring nothing new, batch after batch.

    ``history``: ``tokens``, ``since``. ``inbox``: ``entry_id`` (unique), ``batch_no``, ``tokens``, ``since``. Rows
    without tokens name no record and are never known. A null ``batch_no`` comes after all others. The index of the
    history is built in ``index_path``, by default in a folder that goes with the driver; ``TokenIndex.open`` goes on from
    it in later runs.
    """
    pending = materialize(inbox.where(F.col("entry_id").isNotNull()).select("entry_id", F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch_no"), "tokens", "since"), "inbox-tokens")
    index = TokenIndex.build(history, threshold, path=index_path)
    return new_rows_left_out(index, pending)


def new_rows_left_out(index: TokenIndex, pending: DataFrame) -> DataFrame:
    """Accept ``pending`` (as ``inbox`` of ``known_rows``, without nulls) and return the ``entry_id`` of the other rows."""
    index.accept(index.stage(pending))
    accepted = index.accepted()
    if index.state["base"] != "base-0":
        accepted = materialize(accepted, "index-accepted")
    index.close()
    return pending.where(F.col("tokens").isNotNull()).select("entry_id").join(accepted, "entry_id", "left_anti")
