"""Evaluation items leaking into documents: a q-gram filter over diagonal bands, then banded alignment.

Texts become words (NFC, lower case, runs of letters and digits) joined by single blanks. A leak is a window of w
consecutive words of an item that stands in the document within k edits. By the q-gram lemma, a window of L characters
within k edits shares at least L + 1 - q - k * q q-grams with the document, all within k diagonals of each other. Shared
q-grams are counted by item and diagonal band, bands with fewer are dropped, and the rest is aligned along the band.

Both texts and items stay distributed. A bitmap of fixed size tells which q-grams any item has; documents without
enough of them leave in the first pass, and only the others' q-grams are joined with the items'.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmill.runtime import materialize

#: Words in a row that make a leak, edits allowed in them, and bytes in a q-gram at most and at least.
MIN_WORDS, EDITS, Q, LEAST_Q = 12, 0, 16, 3
#: Bits of the map of the items' q-grams, sent to every executor: 4 MB whatever the number of items.
MAP_BITS = 25
#: Up to so many q-grams of items, 32 bytes each, go to every executor; more are joined by shuffling. The result is the same.
BROADCAST_GRAMS = 1_000_000
#: Bytes of documents that are filtered at a time.
SLICE_BYTES = 2_000_000

_APART = re.compile(r"[\W_]+")


def normal(text: str) -> bytes:
    """Words joined and surrounded by single blanks, in UTF-8."""
    s = unicodedata.normalize("NFC", text).lower()
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
    return f" {_APART.sub(' ', s).strip()} ".encode()


def windows(text: bytes, words: int) -> list[tuple[int, int]]:
    """Begin and end of each window of so many words, with the blanks around it."""
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    return [(a, b + 1) for a, b in zip(blanks, blanks[words:])]


def grams(text: bytes, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes at each offset."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = text + b"\0" * 8
    first = np.ndarray((n,), "<u8", raw, 0, (1,))
    if q < 8:
        first = first & np.uint64((1 << 8 * q) - 1)
    last = np.ndarray((n,), "<u8", raw, max(q - 8, 0), (1,)) if q > 8 else first
    with np.errstate(over="ignore"):
        h = first * np.uint64(0x9E3779B97F4A7C15) ^ (last * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) ^ last
        return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def within(doc: bytes, item: bytes, at: list[tuple[int, int]], low: int, high: int, edits: int) -> bool:
    """Whether some window of the item stands in the document within ``edits``, beginning on a diagonal in
    ``low .. high``. An alignment of cost k strays k diagonals at most, so the table is that much wider."""
    if not edits:
        return any(_equal(doc, item, d, at) for d in range(low, high + 1))
    left, width = low - edits, high - low + 2 * edits + 1
    text = np.full(len(item) + width + 2, -1, np.int64)
    begin, end = max(0, left), min(len(doc), left + len(text))
    if end > begin:
        text[begin - left : end - left] = np.frombuffer(doc, np.uint8)[begin:end]
    steps = np.arange(width)
    for a, b in at:
        # row[s]: cheapest alignment of the item's bytes so far that ends on diagonal left + s; it may begin on low .. high
        row = np.where((steps >= edits) & (steps < width - edits), 0, edits + 1)
        for i in range(a, b):
            down = np.append(row[1:], edits + 1) + 1
            row = np.minimum(row + (text[i : i + width] != item[i]), down)
            row = np.minimum.accumulate(row - steps) + steps
            if row.min() > edits:
                break
        else:
            return True
    return False


def _equal(doc: bytes, item: bytes, shift: int, at: list[tuple[int, int]]) -> bool:
    """Whether a window's bytes are equal on one diagonal."""
    lo, hi = max(0, shift), min(len(doc), len(item) + shift)
    if hi <= lo:
        return False
    odd = np.flatnonzero(np.frombuffer(doc, np.uint8)[lo:hi] != np.frombuffer(item, np.uint8)[lo - shift : hi - shift]) + lo - shift
    at = [(a, b) for a, b in at if a + shift >= lo and b + shift <= hi]
    begins, ends = np.array([a for a, _ in at], np.int64), np.array([b for _, b in at], np.int64)
    return bool((np.searchsorted(odd, begins) == np.searchsorted(odd, ends)).any())


def item_texts(items: DataFrame, words: int) -> DataFrame:
    """``item_id, item, least``: the normalized text of the items that have a window, and the length of the shortest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, t, min(b - a for a, b in w)) for i, t in zip(pdf["item_id"], map(normal, pdf["text"]), strict=True) if (w := windows(t, words))]
            yield pd.DataFrame(out, columns=["item_id", "item", "least"])

    picked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInPandas(run, "item_id bigint, item binary, least bigint")


def item_grams(texts: DataFrame, q: int, edits: int) -> DataFrame:
    """``gram, item_id, pos, need``: the items' q-grams and how many a band of the item must have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t, least in zip(pdf["item_id"], pdf["item"], pdf["least"], strict=True):
                g = grams(t, q).view(np.int64)
                yield pd.DataFrame({"gram": g, "item_id": i, "pos": np.arange(len(g), dtype=np.int64), "need": least + 1 - q - edits * q})

    return texts.mapInPandas(run, "gram bigint, item_id bigint, pos bigint, need bigint")


def crowded(places: np.ndarray, need: int, span: int) -> np.ndarray:
    """Which of the sorted places lie with ``need - 1`` others within ``span``."""
    first = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] <= span) if len(places) >= need else np.zeros(0, np.int64)
    change = np.zeros(len(places) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + need, -1)
    return np.cumsum(change[:-1]) > 0


def suspects(documents: DataFrame, bitmap: np.ndarray, q: int, need: int, span: int) -> DataFrame:
    """``doc_id, doc, grams, places``: the documents with at least ``need`` q-grams that the bitmap has within ``span``
    bytes, and these with their place. Any part of a leak as long as the shortest window has that many, so no q-gram of a
    leak is left out."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = shared.value, np.uint64(64 - MAP_BITS)
        for batch in batches:
            ids, texts, hashes, places, sizes = [], [], [], [], []
            column, k = batch.column(1), 0
            while k < batch.num_rows:
                docs, total, first = [], 0, k
                while k < batch.num_rows and total < SLICE_BYTES:
                    docs.append(normal(column[k].as_py()))
                    total += len(docs[-1])
                    k += 1
                starts = np.cumsum([0] + [len(t) for t in docs])
                g = grams(b"".join(docs), q)
                slot = (g >> shift).astype(np.int64)
                at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                doc = np.searchsorted(starts, at, "right") - 1
                inside = at + q <= starts[doc + 1]
                at, doc = at[inside], doc[inside]
                begins = np.searchsorted(doc, np.arange(len(docs) + 1))
                for d in np.flatnonzero(np.diff(begins) >= need).tolist():
                    mine = at[begins[d] : begins[d + 1]]
                    mine = mine[crowded(mine, need, span)]
                    if not len(mine):
                        continue
                    ids.append(batch.column(0)[first + d].as_py())
                    texts.append(docs[d])
                    hashes.append(g[mine].view(np.int64))
                    places.append(mine - starts[d])
                    sizes.append(len(mine))
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())) for x in (hashes, places)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), *lists], ["doc_id", "doc", "grams", "places"])

    picked = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, doc binary, grams array<bigint>, places array<bigint>")


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, edits: int = EDITS) -> DataFrame:
    """``(doc_id, item_id)``: the document holds ``min_words`` consecutive words of the item, with the blanks around them
    and within ``edits`` edits (of bytes in UTF-8), consecutive in both.

    ``documents``: ``doc_id``, ``text``; ``items``: ``item_id``, ``text``. Null and empty texts, and items of fewer
    words, leak nothing. Equal documents are each reported; equal ids are one. The q-grams are as long as the edits allow,
    so that the shortest window still has to share one; edits for which that would take q-grams of fewer than three bytes
    are refused.
    """
    spark = documents.sparkSession
    texts = materialize(item_texts(items, min_words), "leak-items")
    shortest = texts.agg(F.min("least")).first()[0]
    if shortest is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    q = min(Q, shortest // (edits + 1))
    if q < LEAST_Q:
        raise ValueError(f"{edits} edits are too many for a passage of {shortest} bytes")
    postings = materialize(item_grams(texts, q, edits), "leak-grams")
    # at most 2 ** MAP_BITS / 64 words reach the driver
    word, bit = F.shiftrightunsigned("gram", 64 - MAP_BITS + 6), F.shiftrightunsigned("gram", 64 - MAP_BITS).bitwiseAND(F.lit(63)).cast("int")
    words = postings.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).toArrow()
    bitmap = np.zeros(1 << MAP_BITS - 6, "<i8")
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    found = materialize(suspects(documents, bitmap.view(np.uint8), q, shortest + 1 - q - edits * q, shortest + edits - q), "leak-suspects")

    hits = found.select("doc_id", F.explode(F.arrays_zip("grams", "places")).alias("z")).select("doc_id", F.col("z.grams").alias("gram"), F.col("z.places").alias("place"))
    # bands overlap by half, so that diagonals at most ``edits`` apart are in one of them together
    diagonal, span = F.col("place") - F.col("pos"), edits + 1
    band = F.floor(diagonal / span).cast("bigint")
    bands = F.explode(F.array(band, band - 1)) if edits else band
    counted = (
        hits.join(F.broadcast(postings) if postings.count() <= BROADCAST_GRAMS else postings, "gram")
        .select("doc_id", "item_id", "need", bands.alias("band"))
        .groupBy("doc_id", "item_id", "band")
        .agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        .where("n >= need")
        .groupBy("doc_id", "item_id")
        .agg(F.collect_list("band").alias("bands"))
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for doc, item, each in zip(pdf["doc"], pdf["item"], pdf["bands"], strict=True):
                at = windows(item, min_words)
                keep.append(any(within(doc, item, at, b * span, b * span + (2 * span - 1 if edits else 0), edits) for b in sorted(each)))
            yield pdf.loc[keep, ["doc_id", "item_id"]]

    regions = found.select("doc_id", "doc").join(counted, "doc_id").join(texts.select("item_id", "item"), "item_id")
    return regions.select("doc_id", "item_id", "doc", "item", "bands").mapInPandas(verify, "doc_id bigint, item_id bigint").distinct()
