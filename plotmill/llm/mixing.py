"""Mixing sources to target shares, by hash-threshold histograms.

Each document has a hash, uniform in [0, 1). For each source the tokens are summed by hash bucket; running sums of the
histogram show in which bucket the budget is reached. Only that bucket is split again, by the next bits of the hash,
until it holds one hash value or the bits end. The result is a threshold per source: the documents below it are in.
Budgets above the source's size are met by whole repetitions plus one threshold for the repetition on top, so the
selections for 1, 2, ... repetitions are nested. Nothing is sorted and no list of documents leaves the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmill.runtime import materialize

#: The public tokenizer whose tokens measure a document; a path to a ranks file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bits of the hash used per round, and in all.
ROUND_BITS, HASH_BITS = 10, 60
#: Targets are a stated list of sources; a longer one is refused.
MAX_SOURCES = 10_000


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``tokens``: the number of tokens of the whole text; 0 for null and empty texts."""
    schema = documents.select(*keep).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        words = regex.compile(public_tokenizers.PATTERN)

        def size(t: str | None) -> int:
            if not t:
                return 0
            try:
                return len(enc.encode_ordinary(t))
            except BaseException as e:  # noqa: BLE001
                if "panic" not in type(e).__name__.lower() and not isinstance(e, ValueError):
                    raise
                # the tokenizer's own splitting gives up on very long stretches of one kind; its pieces don't depend on it
                return sum(len(enc._encode_single_piece(w)) for w in words.findall(t))

        for batch in batches:
            counts = pa.array([size(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*batch.schema.names[:-1], "tokens"])

    return documents.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _bucket(h: Column, used: int) -> Column:
    return F.shiftright(h, HASH_BITS - used - ROUND_BITS).bitwiseAND(F.lit((1 << ROUND_BITS) - 1))


def _thresholds(docs: DataFrame, budgets: dict[str, int]) -> dict[str, int]:
    """Per source the largest hash bound below which the tokens don't exceed the budget.

    A round has at most 2 ** ROUND_BITS sums per source; their running sums are made on the executors, and one row per
    source comes back: its boundary bucket, and the tokens before that."""
    low = dict.fromkeys(budgets, 0)  # everything below is in
    left = dict(budgets)
    used, last = 0, 1 << ROUND_BITS
    while left and used < HASH_BITS:
        bound = F.broadcast(docs.sparkSession.createDataFrame([(s, low[s] >> (HASH_BITS - used), n) for s, n in left.items()], "source string, prefix bigint, room bigint"))
        inside = docs.join(bound, "source").where(F.shiftright("h", HASH_BITS - used) == F.col("prefix"))
        sums = inside.groupBy("source", "room", _bucket(F.col("h"), used).alias("b")).agg(F.sum("tokens").alias("n"))
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        over = F.col("upto") > F.col("room")
        ends = running.groupBy("source").agg(F.coalesce(F.min(F.when(over, F.col("b"))), F.lit(last)).alias("b"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("taken"))
        found = {r["source"]: (r["b"], r["taken"]) for r in ends.collect()}
        step = 1 << (HASH_BITS - used - ROUND_BITS)
        for s in list(left):
            b, taken = found.get(s, (last, 0))
            low[s] += b * step
            left[s] -= taken
            if b == last:
                del left[s]
        used += ROUND_BITS
    return low


class Mixture:
    """``documents`` (``doc_id, source, repeats, tokens``) and ``shares`` per source."""

    def __init__(self, documents: DataFrame, shares: DataFrame) -> None:
        self.documents, self.shares = documents, shares


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> Mixture:
    """Draw documents so that each source has its target share of all tokens.

    ``documents``: ``doc_id``, ``source``, ``text``. ``targets``: ``source``, ``target_share``, ``max_repeats``. Case and
    outer blanks of ``source`` don't count; sources without a target, and null ones, stay out. ``total_tokens`` is the
    wanted size of the mix; by default the largest one in which every source that has tokens can meet its share within
    its repeats. A source that can't meet it is used up to its cap, and its actual share shows that. Sources without
    tokens are reported with share 0; the others keep their target shares of the total. A document is in ``repeats``
    times, never more than ``max_repeats``; documents with 0 tokens count as any other. Equal ``doc_id`` share a hash and
    are in or out together. Null ids, and targets with a null or non-positive share or repeats, are left out. A source
    falls short of its budget by less than the tokens under one hash value.
    """
    spark = documents.sparkSession
    name = F.lower(F.trim("source"))
    wanted = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy(name.alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    rows = wanted.where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = {r["source"]: (r["share"], r["cap"]) for r in rows}
    listed = spark.createDataFrame([(s,) for s in goal], "source string")
    known = documents.where(F.col("doc_id").isNotNull()).select("doc_id", name.alias("source"), "text").join(F.broadcast(listed), "source", "left_semi")
    counted = count_tokens(known, ["doc_id", "source"], "text", tokenizer)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - HASH_BITS).alias("h")
    docs = materialize(counted.select("doc_id", "source", "tokens", h), "mix-tokens")

    sizes = {r["source"]: int(r["n"] or 0) for r in docs.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    able = {s: n for s, n in sizes.items() if n > 0}
    if total_tokens is None:
        total_tokens = int(min((goal[s][1] * n / goal[s][0] for s, n in able.items()), default=0))
    whole, budgets = dict.fromkeys(goal, 0), {}
    for s, n in able.items():
        share, cap = goal[s]
        budget = int(share * total_tokens + 0.5)
        whole[s] = min(cap, budget // n)
        if whole[s] < cap:
            budgets[s] = budget - whole[s] * n
    bounds = _thresholds(docs, budgets)
    plan = spark.createDataFrame([(s, *goal[s], whole[s], bounds.get(s, 0)) for s in goal], "source string, target_share double, cap int, whole int, bound bigint")
    drawn = docs.join(F.broadcast(plan), "source").select("doc_id", "source", (F.col("whole") + (F.col("h") < F.col("bound")).cast("int")).alias("repeats"), "tokens").where("repeats > 0")
    used = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = used.agg(F.sum("tokens").alias("total"))
    shares = (
        plan.select("source", "target_share")
        .join(F.broadcast(used), "source", "left")
        .join(F.broadcast(total))
        .select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)).alias("actual_share"))
    )
    return Mixture(drawn, shares)
