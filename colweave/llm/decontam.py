"""Benchmark decontamination by winnowing.

Of the k-gram hashes in each window of words the smallest, the rightmost of equals, is
kept with its place; neighbouring windows mostly keep the same one, so a text has far
fewer fingerprints than words.  Equal windows keep the same k-gram, so a document that
shares a window with an item shares its fingerprint.  The fingerprints of documents and
items are joined as rows; each one that meets another is extended to the windows it was
kept for, whose words decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.llm import words as W
from colweave.session import materialise, ready_workers

WINDOW_WORDS = 10
GRAM_WORDS = 5
# Fingerprints of the benchmark as a bit map: 8 MB whatever the benchmark's size.
MAP_BITS = 1 << 26


def _winnowed(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` words its kept fingerprint and the place of that k-gram."""
    gram = min(GRAM_WORDS, length)
    grams = W.runs(hashes, gram)
    n = max(0, len(hashes) - length + 1)
    last = length - gram
    least, place = grams[last:last + n].copy(), np.arange(last, last + n)
    for j in range(last - 1, -1, -1):
        less = grams[j:j + n] < least
        least[less] = grams[j:j + n][less]
        place[less] = np.flatnonzero(less) + j
    return W.mix(least ^ np.uint64(length)), place


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in W.chunks(batch.column(1)):
                found = W.split(data, offsets, W.ALPHANUMERIC)
                hashes = found.hashes()
                ids, texts, prints, lengths = [], [], [], []
                for d, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
                    if a == b:
                        continue
                    length = min(window, b - a)
                    fingers, _ = _winnowed(hashes[a:b], length)
                    item = batch.column(0)[low + d].as_py()
                    for i in range(len(fingers)):
                        ids.append(item)
                        texts.append(found.text(a + i, length))
                        lengths.append(length)
                    prints.append(fingers)
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array(lengths, pa.int32()),
                         pa.array(np.concatenate(prints).view(np.int64))], ["item_id", "words", "length", "print"])
        W.release()

    return run


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``(item_id string, words binary, length, print)`` for every window of every item."""
    texts = ready_workers(benchmark).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_item_windows(window), "item_id string, words binary, length int, print long")


def _bit_map(spark: SparkSession, windows: DataFrame) -> np.ndarray:
    """The fingerprints as bits; at most ``MAP_BITS / 64`` rows of two numbers reach the driver."""
    place = F.expr(f"print & {MAP_BITS - 1}L")
    cells = (windows.select(F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(print & 63 as int))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    out[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _candidates(lengths: list[int], held):
    """A row per document with its number of words, and per kept fingerprint that the bit map knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            rows, numbers, starts, counts, sizes, prints, texts = [], [], [], [], [], [], []
            for low, high, data, offsets in W.chunks(batch.column(2)):
                found = W.split(data, offsets, W.ALPHANUMERIC)
                hashes = found.hashes()
                rows += range(low, high)
                numbers += np.diff(found.first).tolist()
                for column in (starts, counts, sizes, prints, texts):
                    column += [None] * (high - low)
                for length in lengths:
                    if len(hashes) < length:
                        continue
                    fingers, place = _winnowed(hashes, length)
                    cell = fingers & np.uint64(MAP_BITS - 1)
                    known = (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
                    at = np.flatnonzero(known & found.fits(length)[:len(fingers)])
                    if not len(at):
                        continue
                    # Windows that keep the same k-gram are one fingerprint; texts end between windows that fit.
                    owner = np.searchsorted(found.first, at, side="right") - 1
                    opens = np.flatnonzero(np.concatenate([[True], (np.diff(place[at]) != 0) | (np.diff(at) != 1) | (np.diff(owner) != 0)]))
                    many = np.diff(np.append(opens, len(at)))
                    first = at[opens]
                    rows += (low + owner[opens]).tolist()
                    numbers += [None] * len(first)
                    starts += (first - found.first[owner[opens]]).tolist()
                    counts += many.tolist()
                    sizes += [length] * len(first)
                    prints += fingers[first].view(np.int64).tolist()
                    texts += [found.text(i, n + length - 1) for i, n in zip(first.tolist(), many.tolist())]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(counts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(texts, pa.binary())],
                ["doc_id", "text_key", "n_words", "start", "windows", "length", "print", "words"])
        W.release()

    return run


def _extended(found: DataFrame, prints: DataFrame) -> DataFrame:
    """``(doc_id, text_key, start, length, words)``: the windows of the fingerprints that documents and items share."""
    met = found.where("words IS NOT NULL").join(prints, ["print", "length"])
    listed = F.split(F.col("words").cast("string"), " ")
    each = met.select("doc_id", "text_key", "start", "length", listed.alias("listed"), F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("step"))
    return each.select("doc_id", "text_key", (F.col("start") + F.col("step")).alias("start"), "length",
                       F.array_join(F.slice("listed", F.col("step") + 1, F.col("length")), " ").cast("binary").alias("words"))


def _spans(places: DataFrame) -> DataFrame:
    """``(doc_id, text_key, spans, n_hit)``: the merged runs of hit words, in order."""
    places = places.select("doc_id", "text_key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (places.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
            .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "text_key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    return runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
                                                  F.sum(F.col("end") - F.col("start")).alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, n_items, items, spans, contaminated)`` per document row.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased.  ``window`` consecutive words of an item are a window; a shorter item
    is one window, one without words none.  A document word inside any occurrence of
    a window is hit: ``n_hit`` counts them, ``spans`` are the merged runs as
    ``(start, end)`` word places, ``items`` the item_ids with an occurring window,
    sorted as strings (null item_ids and null texts are left out).

    A null or empty text has no words.  Documents are told apart by ``doc_id`` and
    ``text_key``, the text's xxhash64; repeated rows and ids stay one row each.

    Only fingerprints that a bit map of fixed size knows leave their task; the map has no
    say in the result.  They are joined to the benchmark's fingerprints, each of which is
    one row however many items or documents hold it, and extended to windows, which meet
    the benchmark's windows on their words.  Neither side is broadcast unless Spark
    knows it to be small.  The work grows with the number of hits, in one text or in many.
    """
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark.where("item_id IS NOT NULL AND text IS NOT NULL"), window))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `window` values
    held = spark.sparkContext.broadcast(_bit_map(spark, windows))
    texts = ready_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                                       F.col("text").cast("binary").alias("text"))
    found = materialise(texts.mapInArrow(
        _candidates(lengths, held),
        "doc_id long, text_key long, n_words long, start long, windows int, length int, print long, words binary"))
    # Places carry a window's number; its items meet each (document, window) once, as rows.
    known = materialise(windows.select("words").distinct().withColumn("window", F.monotonically_increasing_id()))
    owners = windows.join(known, "words").select("window", "item_id").distinct()
    prints = materialise(windows.select("print", "length").distinct())
    places = materialise(_extended(found, prints).join(known, "words").select("doc_id", "text_key", "start", "length", "window"))
    items = (places.select("doc_id", "text_key", "window").distinct().join(owners, "window")
             .select("doc_id", "text_key", "item_id").distinct()
             .groupBy(F.col("doc_id").alias("_item_id"), F.col("text_key").alias("_item_key"))
             .agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    spots = _spans(places).join(items, F.col("doc_id").eqNullSafe(F.col("_item_id")) & (F.col("text_key") == F.col("_item_key")))
    hits = spots.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "items", "spans", "n_hit")
    rows = found.where("n_words IS NOT NULL").select("doc_id", "text_key", "n_words")
    joined = rows.join(hits, rows.doc_id.eqNullSafe(hits["_id"]) & (rows.text_key == hits["_key"]), "left")
    return joined.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; columns unchanged."""
    bad = materialise(contamination(docs, benchmark, window).where("contaminated")
                      .select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct())
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad["_bad_id"])
                     & (F.xxhash64(docs.text) == bad["_bad_key"]), "left_anti")
