"""Toxicity by class-conditional Kneser-Ney models of words.

A word is spelled byte by byte.  Each class has its own counts of what follows the last
four bytes; below that, all documents share one chain of continuation counts (in how many
different contexts a shorter run occurs), so an expression that a class hardly knows is
judged by the common spelling, not by the size of the class.  A document's evidence is
the difference of its two log-likelihoods over its number of words.

Words are counted once per document and kept in files, one per chunk of documents.  What
the model knows of a chunk's byte runs is joined to the chunk as rows; neither the counts
nor the weights pass through the driver or a broadcast, and they grow with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from colweave.llm import store
from colweave.llm import words as W
from colweave.session import materialise, ready_workers

# Bytes of a run: four of context and the one that follows.  Runs are packed into a long, eight bits a byte.
ORDER = 5
# Where fewer bytes of a word are known the classes share the counts: beginnings of words tell the language.
OWN_CONTEXT = 2
# Added to the number of words when evidence is divided by it, so that a few words alone say little.
EXTRA_WORDS = 30
# A chunk ends at this many bytes of text or documents; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_DOCS = 10 << 20, 50_000
# One labelled document in so many calibrates the score and is not counted.
CALIBRATION = 5
# Evidence is counted in cells for the calibration.
EVIDENCE_RANGE, EVIDENCE_CELLS = 2.0, 20_000
# Every chunk has this row, also one without words; packed runs are never negative.
NO_RUN = -1
END = 0x20


@dataclass
class Sheets:
    """Counted documents: ``rows(chunk, place, doc_id, run)`` has a row per document and per run of a chunk."""

    folder: str
    rows: DataFrame
    kept: StructType


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(bytes, offsets, first document)`` of about ``W.CHUNK_BYTES``; long texts are cut between words."""
    row, last = 0, len(offsets) - 1
    while row < last:
        stop = int(np.searchsorted(offsets, offsets[row] + W.CHUNK_BYTES, side="right")) - 1
        if stop > row:
            yield data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row], row
            row = stop
            continue
        low, end = int(offsets[row]), int(offsets[row + 1])
        while low < end:
            high = min(end, low + W.CHUNK_BYTES)
            while high < end:
                gap = np.flatnonzero(~W.ALPHANUMERIC[W.LOWER[data[high:high + W.CHUNK_BYTES]]])
                high = min(end, high + (int(gap[0]) if len(gap) else W.CHUNK_BYTES))
                if len(gap):
                    break
            yield data[low:high], np.array([0, high - low]), row
            low = high
        row += 1


def pack(words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(run, word)`` at each byte and at the end of each word; ``words`` holds their bytes one after the other."""
    total = length + 1
    first = np.cumsum(total) - total
    word = np.repeat(np.arange(len(length)), total)
    within = np.arange(len(word)) - first[word]
    data = np.full(len(word), END, dtype=np.int64)
    data[within < length[word]] = words
    run = data.copy()
    for back in range(1, ORDER):
        known = within >= back
        run[known] |= data[np.flatnonzero(known) - back] << (8 * back)
    return run, word


class _Chunk:
    """Word counts of some documents."""

    def __init__(self) -> None:
        self.number = uuid.uuid4().int >> 65
        self.kept: list[pa.RecordBatch] = []
        self.docs = self.bytes = 0
        self.doc, self.hash, self.count = [], [], []
        self.words, self.length, self.named = [], [], []

    def add(self, kept: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        for part, edges, row in segments(data, offsets):
            words = W.split(part, edges, W.ALPHANUMERIC)
            hashes = words.hashes()
            named, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            doc = np.repeat(np.arange(len(edges) - 1), np.diff(words.first))
            cell, count = np.unique(doc * max(1, len(named)) + inverse, return_counts=True)
            self.doc.append((self.docs + row + cell // max(1, len(named))).astype(np.uint32))
            self.hash.append(named[cell % max(1, len(named))])
            self.count.append(count.astype(np.uint32))
            length = words.end[at] - words.start[at]
            before = np.cumsum(length) - length
            self.words.append(words.data[np.repeat(words.start[at] - before, length) + np.arange(length.sum())])
            self.length.append(length)
            self.named.append(named)
        self.kept.append(kept)
        self.docs += len(offsets) - 1
        self.bytes += len(data)

    def close(self, folder: str) -> tuple[int, int, np.ndarray]:
        """Write the file; the chunk's number, its documents and its distinct runs."""
        named, length = np.concatenate([*self.named, np.zeros(0, np.uint64)]), np.concatenate([*self.length, np.zeros(0, np.int64)])
        text = np.concatenate([*self.words, np.zeros(0, np.uint8)])
        known, at = np.unique(named, return_index=True)
        word = np.searchsorted(known, np.concatenate([*self.hash, np.zeros(0, np.uint64)]))
        self.hash = self.named = self.words = self.length = None
        # Frequent words get small numbers, which pack better.
        rank = np.empty(len(known), dtype=np.int64)
        order = np.argsort(-np.bincount(word, minlength=len(known)), kind="stable")
        rank[order] = np.arange(len(known))
        at = at[order]
        cell = np.concatenate([*self.doc, np.zeros(0, np.uint32)]).astype(np.int64) * max(1, len(known)) + rank[word]
        cell, place = np.unique(cell, return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([*self.count, np.zeros(0, np.uint32)]), minlength=len(cell)).astype(np.int64)
        doc, word = cell // max(1, len(known)), cell % max(1, len(known))
        first = np.searchsorted(doc, np.arange(self.docs + 1))
        steps = np.diff(word, prepend=0)
        opens = first[:-1][first[:-1] < len(word)]
        steps[opens] = word[opens]
        starts = np.cumsum(length) - length
        size = length[at]
        before = np.cumsum(size) - size
        run, owner = pack(text[np.repeat(starts[at] - before, size) + np.arange(size.sum())], size)
        runs, run_at = np.unique(run, return_inverse=True)
        arrays = {"first": first, "step": steps, "count": count, "run_word": np.diff(owner, prepend=0), "run_at": run_at, "runs": runs}
        parts = pa.record_batch([pa.array([x.astype(np.int64 if name == "runs" else np.uint32)]) for name, x in arrays.items()],
                                list(arrays))
        stream, _ = store.open_output(folder, f"{self.number}.arrow")
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with stream:
            with pa.ipc.new_stream(stream, parts.schema, options=options) as out:
                out.write_batch(parts)
            with pa.ipc.new_stream(stream, self.kept[0].schema, options=options) as out:
                for batch in self.kept:
                    out.write_batch(batch)
        return self.number, self.docs, runs


@dataclass
class _Counts:
    """A chunk as read back: words and counts of each document, and the runs of each word."""

    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray
    run_word: np.ndarray
    run_at: np.ndarray
    runs: np.ndarray
    size: np.ndarray
    kept: pa.Table

    @staticmethod
    def read(folder: str, chunk: int) -> _Counts:
        with store.open_input(f"{folder}/{chunk}.arrow") as source:
            parts = pa.ipc.open_stream(source).read_all()
            kept = pa.ipc.open_stream(source).read_all()
        first, step, count, run_word, run_at, runs = (parts.column(k).chunk(0).values.to_numpy().astype(np.int64) for k in range(6))
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        upto = np.concatenate([[0], np.cumsum(step)])
        word = upto[1:] - upto[first[:-1]][doc]
        size = np.bincount(doc, weights=count, minlength=len(first) - 1).astype(np.int64)
        return _Counts(doc, word, count, np.cumsum(run_word), run_at, runs, size, kept)


def count_words(docs: DataFrame, keep: list[str | Column]) -> Sheets:
    """Tokenise whole texts once: lower-case words of letters and digits, counted per document.

    ``keep`` are the columns that scores come back with; ``doc_id`` meets the labels.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in keep]
    frame = ready_workers(docs).select(*columns)
    kept = frame.schema
    frame = docs.select(*columns, F.col("doc_id").alias("_doc_id"), F.col("text").cast("binary").alias("_text"))
    folder = store.new_folder(docs.sparkSession, "sheets")
    width = len(kept)
    schema = StructType([StructField("chunk", LongType()), StructField("place", IntegerType()),
                         StructField("doc_id", frame.schema["_doc_id"].dataType), StructField("run", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids = _Chunk(), []

        def close() -> Iterator[pa.RecordBatch]:
            number, n, runs = chunk.close(folder)
            named = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array(np.arange(n), pa.int32()), named, pa.nulls(n, pa.int64())], schema.names)
            m = len(runs) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, number)), pa.nulls(m, pa.int32()), pa.nulls(m, named.type),
                 pa.array(np.concatenate([[NO_RUN], runs]))], schema.names)

        for batch in batches:
            data, offsets = W.binary_parts(batch.column(width + 1))
            row = 0
            while row < batch.num_rows:
                room = max(0, CHUNK_BYTES - chunk.bytes)
                stop = int(np.searchsorted(offsets, offsets[row] + room, side="right")) - 1
                stop = min(max(stop, row + 1), row + CHUNK_DOCS - chunk.docs, batch.num_rows)
                chunk.add(pa.RecordBatch.from_arrays(batch.columns[:width], kept.names).slice(row, stop - row) if width
                          else batch.slice(row, stop - row).select([]),
                          data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
                ids.append(batch.column(width).slice(row, stop - row))
                row = stop
                if chunk.bytes >= CHUNK_BYTES or chunk.docs >= CHUNK_DOCS:
                    yield from close()
                    chunk, ids = _Chunk(), []
        if chunk.docs:
            yield from close()
        W.release()

    return Sheets(folder, materialise(frame.mapInArrow(run, schema)), kept)


def _labelled(sheets: Sheets, labels: DataFrame) -> DataFrame:
    """``(chunk, place, toxic, calibrates)`` of the labelled documents."""
    known = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most"))
    by = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(CALIBRATION)) == 0
    return materialise(sheets.rows.where("place IS NOT NULL").select("chunk", "place", "doc_id")
                       .join(known.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id")
                       .select("chunk", "place", "toxic", by.alias("calibrates")))


def _class_counts(sheets: Sheets, taught: DataFrame) -> DataFrame:
    """``(run, toxic, ordinary)`` in the words of the taught documents, per chunk."""
    folder = sheets.folder

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sheet = _Counts.read(folder, key[0].as_py())
        label = np.full(len(sheet.size), -1)
        label[group.column("place").to_numpy()] = group.column("toxic").to_numpy()
        found = []
        for value in (1, 0):
            chosen = label[sheet.doc] == value
            words = np.bincount(sheet.word[chosen], weights=sheet.count[chosen], minlength=sheet.run_word.max(initial=-1) + 1)
            found.append(np.bincount(sheet.run_at, weights=words[sheet.run_word], minlength=len(sheet.runs)).astype(np.int64))
        some = found[0] + found[1] > 0
        return pa.table({"run": sheet.runs[some], "toxic": found[0][some], "ordinary": found[1][some]})

    return taught.groupBy("chunk").applyInArrow(run, "run long, toxic long, ordinary long")


def _discount(ones: int | None, twos: int | None) -> float:
    return ones / (ones + 2 * twos) if ones else 0.5


def _smoothed(count: Column, discount: float, below: Column, context: Column) -> Column:
    """Interpolated Kneser-Ney: discounted counts, and what was taken off goes to the shorter context's ``below``."""
    within = Window.partitionBy(context)
    total, kinds = F.sum(count).over(within), F.sum(F.when(count > 0, 1).otherwise(0)).over(within)
    mixed = (F.greatest(count - F.lit(discount), F.lit(0.0)) + F.lit(discount) * kinds * below) / total
    return F.when(total > 0, mixed).otherwise(below)


def run_weights(counts: DataFrame) -> DataFrame:
    """``(run, weight)``: the log of how much likelier a run's last byte is in toxic documents.

    ``counts(run, toxic, ordinary)`` has every run of the corpus, with its counts in
    the taught documents of each class.  A context is followed by at most 256 bytes, so
    each window holds a few rows.
    """
    def ends(n: int) -> Column:
        return F.col("run").bitwiseAND(F.lit((1 << (8 * n)) - 1))

    levels, above = [], counts.select("run")
    for order in range(ORDER - 1, 0, -1):
        above = above.groupBy(ends(order).alias("run")).agg(F.count("*").alias("contexts"))
        levels.append(above.select(F.lit(order).alias("level"), "run", "contexts"))
        above = above.select("run")
    shared = levels[0]
    for level in levels[1:]:
        shared = shared.unionAll(level)
    shared = materialise(shared)
    seen = {r["level"]: _discount(r["ones"], r["twos"]) for r in shared.groupBy("level").agg(
        F.count_if(F.col("contexts") == 1).alias("ones"), F.count_if(F.col("contexts") == 2).alias("twos")).collect()}
    below = None
    for order in range(1, ORDER):
        level = shared.where(F.col("level") == order).select("run", "contexts")
        base = F.lit(1.0 / 256)
        if below is not None:
            level = level.withColumn("suffix", ends(order - 1)).join(below, "suffix")
            base = F.col("below")
        below = level.select(F.col("run").alias("suffix"),
                             _smoothed(F.col("contexts"), seen.get(order, 0.5), base, F.shiftright("run", 8)).alias("below"))
    own = counts.agg(*(F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in ("toxic", "ordinary") for n in (1, 2))).first()
    known = F.shiftright("run", 8 * OWN_CONTEXT).bitwiseAND(F.lit(255)) != 0
    of = {c: _smoothed(F.col(c), _discount(own[f"{c}1"], own[f"{c}2"]), F.col("below"), F.shiftright("run", 8))
          for c in ("toxic", "ordinary")}
    return (counts.withColumn("suffix", ends(ORDER - 1)).join(below, "suffix")
            .select("run", F.when(known, F.ln(of["toxic"]) - F.ln(of["ordinary"])).otherwise(F.lit(0.0)).alias("weight")))


def _evidence(sheets: Sheets, weights: DataFrame) -> DataFrame:
    """The kept columns of every document with ``_chunk``, ``_place``, ``_n_words`` and ``_evidence``."""
    folder = sheets.folder
    schema = StructType([*sheets.kept.fields, StructField("_chunk", LongType()), StructField("_place", IntegerType()),
                         StructField("_n_words", LongType()), StructField("_evidence", DoubleType())])
    chunks = (sheets.rows.where("run IS NOT NULL").select("chunk", "run").join(weights, "run", "left")
              .select("chunk", "run", F.coalesce("weight", F.lit(0.0)).alias("weight")))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sheet = _Counts.read(folder, key[0].as_py())
        named, weight = group.column("run").to_numpy(), group.column("weight").to_numpy()
        real = named != NO_RUN
        # Exactly the runs of the file, each once.
        by_run = weight[real][np.argsort(named[real])]
        words = np.bincount(sheet.run_word, weights=by_run[sheet.run_at], minlength=sheet.run_word.max(initial=-1) + 1)
        n = len(sheet.size)
        total = np.bincount(sheet.doc, weights=sheet.count * words[sheet.word], minlength=n)
        return pa.Table.from_arrays(
            [*sheet.kept.columns, pa.array(np.full(n, key[0].as_py())), pa.array(np.arange(n), pa.int32()), pa.array(sheet.size),
             pa.array(total / (sheet.size + EXTRA_WORDS))], schema.names)

    return chunks.groupBy("chunk").applyInArrow(run, schema)


def fit_scale(evidence: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope (never negative) and shift of a logistic curve through weighted points, by Newton steps."""
    share = (np.sum(weight * label) + 0.5) / (np.sum(weight) + 1)
    level = float(np.log(share / (1 - share)))
    if len(np.unique(label)) < 2:
        return 0.0, level
    slope, shift = 1.0, level
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * evidence + shift, -40, 40)))
        bend = weight * np.maximum(p * (1 - p), 1e-9)
        miss = weight * (p - label)
        g = np.array([(miss * evidence).sum() + 1e-4 * slope, miss.sum()])
        h = np.array([[(bend * evidence ** 2).sum() + 1e-4, (bend * evidence).sum()], [(bend * evidence).sum(), bend.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(slope), float(shift)) if slope > 0 else (0.0, level)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str | Column] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``) with ``n_words``, ``evidence``, ``score`` and ``predicted``.

    ``labels(doc_id, toxic)`` teaches: rows with 0 or 1 whose doc_id has no contrary row.
    All taught documents are counted but one in ``CALIBRATION``, drawn by hash of doc_id;
    these set the scale of ``score``.  Only the text is an input of a score.

    One row per row of ``docs``; whole texts of any length are read, other columns are
    ignored, repeated rows stay.  A null or empty text, or one without letters and
    digits, has evidence 0.  If the labels lack one class every score is the smoothed
    share of toxic labels; without labels, 0.  ``predicted`` is 1 at a score of 0.5 or more.
    """
    sheets = count_words(docs, keep if keep is not None else ["doc_id"])
    labelled = _labelled(sheets, labels)
    # Where no labelled document was drawn to calibrate, the counted ones do it.
    drawn = {(r["calibrates"], r["toxic"]) for r in labelled.select("calibrates", "toxic").distinct().collect()}
    apart = {(True, 0), (True, 1), (False, 0), (False, 1)} <= drawn
    taught = labelled.where("NOT calibrates") if apart else labelled
    empty = sheets.rows.where(F.col("run") >= 0).select("run", F.lit(0).cast("long").alias("toxic"), F.lit(0).cast("long").alias("ordinary"))
    counts = materialise(empty.unionAll(_class_counts(sheets, taught)).groupBy("run").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    judged = materialise(_evidence(sheets, materialise(run_weights(counts))))
    cell = F.round(F.greatest(F.lit(-EVIDENCE_RANGE), F.least(F.lit(EVIDENCE_RANGE), F.col("_evidence")))
                   * (EVIDENCE_CELLS / (2 * EVIDENCE_RANGE))).cast("int")
    points = (labelled.where("calibrates") if apart else labelled).select(F.col("chunk").alias("_chunk"), F.col("place").alias("_place"), "toxic")
    cells = (judged.select("_chunk", "_place", cell.alias("cell")).join(points, ["_chunk", "_place"])
             .groupBy("cell", "toxic").agg(F.count("*").alias("n")).toPandas())
    if len(cells):
        slope, shift = fit_scale(cells["cell"].to_numpy(dtype=float) * (2 * EVIDENCE_RANGE / EVIDENCE_CELLS),
                                 cells["toxic"].to_numpy(dtype=float), cells["n"].to_numpy(dtype=float))
        score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("_evidence") + F.lit(shift))))
    else:
        score = F.lit(0.0)
    return judged.select(*(F.col(f"`{name}`") for name in sheets.kept.names), F.col("_n_words").alias("n_words"),
                         F.col("_evidence").alias("evidence"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
