"""Quality classifier by co-training of a text view and a metadata view.

Each view trains a logistic model on the labelled sample; over rounds each hands its
most confident predictions over the whole corpus to the other as labels.  Tasks score
all unlabelled documents and sum what the picked ones say; no pool is held.  Both are
calibrated on held-back labels and combined to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm import words as W
from colweave.session import ready_workers

# Bound of the labelled sample; every unlabelled document is scored and may be picked in each round.
LABELLED_ROWS = 3000
BUCKETS = 2048
HASHED_NAMES = 32
ROUNDS = 4
# Share of the unlabelled documents that a view labels for the other, more with each round.
ROUND_SHARE = 0.08
# Odds are counted in cells from -ODDS_RANGE to ODDS_RANGE.
ODDS_RANGE, ODDS_CELLS = 40.0, 4000
# Least deviation that inputs are scaled by: a name that few documents have stays bounded.
LEAST_DEVIATION = {"text": 1e-6, "meta": 0.02}

_CLASSES = {
    "symbol": [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-()"],
    "mark": [ord(c) for c in ".,;:!?'\"-()"],
    "digit": list(range(0x30, 0x3A)),
    "upper": list(range(0x41, 0x5B)),
    "blank": [0x20, 0x09],
    "line": [0x0A],
}


# Bytes in lower case times a factor for each place of a trigram; ``BUCKETS`` is a power of two.
_FIRST, _SECOND, _THIRD = (W.LOWER.astype(np.uint32) * np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def text_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, document)`` of every byte trigram within a document, letters in lower case."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _FIRST[data[:n]]
    h ^= _SECOND[data[1:n + 1]]
    h ^= _THIRD[data[2:]]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(13)
    h &= np.uint32(BUCKETS - 1)
    # The last two bytes of a document begin no trigram.
    inside = np.ones(len(data), dtype=bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    # Single bytes take the byte before along, which is the end of another document.
    return h[inside[:n]].astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - 2, 0))


def layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the metadata view that come from the page's layout: sizes and shares of byte classes."""
    size = np.diff(offsets)
    bounds = offsets.tolist()
    found = np.stack([np.bincount(data[low:high], minlength=256) for low, high in zip(bounds, bounds[1:])])
    rows = [np.log1p(size), *((found[:, members].sum(axis=1)) / np.maximum(size, 1) for members in _CLASSES.values())]
    lines = rows[-1] * size
    rows.append(np.log1p(size / (lines + 1)))
    return np.stack(rows, axis=1)


def _name_bucket(kind: str, value: str | None) -> int:
    return zlib.crc32(f"{kind}={'' if value is None else '=' + value}".encode()) % HASHED_NAMES


def metadata(lang: list, source: list, n_chars: list, shape: np.ndarray) -> np.ndarray:
    """The metadata view: layout, declared length, and hashed language and source."""
    n = len(lang)
    names = np.zeros((n, 2 * HASHED_NAMES))
    places: dict[tuple, int] = {}
    for column, values, base in (("lang", lang, 0), ("source", source, HASHED_NAMES)):
        for i, value in enumerate(values):
            key = (column, value)
            if key not in places:
                places[key] = base + _name_bucket(column, value)
            names[i, places[key]] = 1.0
    declared = np.log1p(np.array([max(0, x or 0) for x in n_chars], dtype=float))
    return np.concatenate([shape, declared[:, None], names], axis=1)


@dataclass
class View:
    """A logistic model on scaled inputs with a calibrated output."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.bias) + self.shift


@dataclass
class QualityModel:
    text: View
    meta: View


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.05, decay: float = 1e-3) -> View:
    """Logistic regression by Adam; columns are scaled to unit deviation, the scale goes into the weights."""
    mean, scale = x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 1e-6)
    z = ((x - mean) * scale).astype(np.float32)
    z[:, x.std(axis=0) < 1e-9] = 0
    w, b = np.zeros(z.shape[1], dtype=np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    # Both classes count alike.
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    for step in range(1, steps + 1):
        back = (weight * (_sigmoid(z @ w + b) - y)).astype(np.float32) / len(y)
        g, gb = z.T @ back + decay * w, float(back.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    weights = w.astype(float) * scale
    weights[x.std(axis=0) < 1e-9] = 0
    return View(weights, float(b - mean @ weights))


def _calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling by Newton steps, with smoothed targets."""
    raw = x @ view.weights + view.bias
    positive, negative = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * raw + c)
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * raw).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(s * raw * raw).sum() + 1e-3, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-6]])
        da, dc = np.linalg.solve(h, g)
        a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -1, 1)
    view.slope, view.shift = max(float(a), 0.0), float(c)


def _refit(view: View, x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, picked: tuple, share: float,
           steps: int = 120, rate: float = 0.05, decay: float = 1e-3) -> View:
    """``view`` after labelled rows and sums over picked rows: ``picked`` is (slopes, slope of the bias, curvatures, same).

    The loss of the picked rows stands by its slope at ``view`` and its curvature, to which
    the labelled rows' own loss gives the shape away from ``view``.
    """
    z = ((x - mean) * scale).astype(np.float32)
    start = np.divide(view.weights, scale, out=np.zeros_like(scale), where=scale > 0)
    start_bias = float(view.bias + mean @ view.weights)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)

    def slope(w, b):
        back = weight * (_sigmoid(z @ w.astype(np.float32) + b) - y)
        return (z.T @ back.astype(np.float32)).astype(float), float(back.sum())

    own, own_bias = slope(start, start_bias)
    g0, gb0, h, hb = picked
    w, b = start.copy(), start_bias
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        g, gb = slope(w, b)
        g = (1 + share) * g + share * (g0 - own + h * (w - start)) + decay * w
        gb = (1 + share) * gb + share * (gb0 - own_bias + hb * (b - start_bias))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    weights = w * scale
    return View(weights, float(b - mean @ weights))


def _cell(odds: np.ndarray) -> np.ndarray:
    return np.clip((odds + ODDS_RANGE) * (ODDS_CELLS / (2 * ODDS_RANGE)), 0, ODDS_CELLS - 1).astype(np.int64)


def _text_mean(weights: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per document the mean weight of its trigrams, zero without any; ``owner`` ascends."""
    first = np.searchsorted(owner, np.arange(n + 1))
    number = np.diff(first)
    sums = np.zeros(n)
    full = number > 0
    if full.any():
        sums[full] = np.add.reduceat(weights[bucket], first[:-1][full])
    return sums / np.maximum(number, 1)


def _both_odds(views: dict, bucket: np.ndarray, owner: np.ndarray, meta: np.ndarray) -> dict:
    return {"text": _text_mean(views["text"].weights, bucket, owner, len(meta)) + views["text"].bias, "meta": views["meta"].odds(meta)}


def _blocks(name: str, bucket: np.ndarray, owner: np.ndarray, meta: np.ndarray, chosen: np.ndarray):
    """``(documents, inputs)`` of a view for the chosen documents, 64 at a time."""
    places = np.flatnonzero(chosen)
    for k in range(0, len(places), 64):
        part = places[k:k + 64]
        if name == "meta":
            yield part, meta[part]
            continue
        low, high = np.searchsorted(owner, part[0]), np.searchsorted(owner, part[-1], side="right")
        at = np.searchsorted(part, owner[low:high])
        own = part[at] == owner[low:high]
        found = np.bincount(at[own] * BUCKETS + bucket[low:high][own], minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS)
        yield part, found / np.maximum(found.sum(axis=1), 1)[:, None]


def _corpus_sums(docs: DataFrame, known: np.ndarray, size: int, add) -> np.ndarray:
    """Sums over all documents with text but the ``known`` ids; ``add(total, bucket, owner, meta, use)`` adds a chunk's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            ids = batch.column(0)
            free = ~(np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), known) & ids.is_valid().to_numpy(zero_copy_only=False))
            lang, source, chars = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for low, high, data, offsets in W.chunks(batch.column(4)):
                bucket, owner = text_buckets(data, offsets)
                meta = metadata(lang[low:high], source[low:high], chars[low:high], layout(data, offsets))
                add(total, bucket, owner, meta, free[low:high] & (np.diff(offsets) > 0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["slot", "value"])

    rows = _frame(docs).mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[rows["slot"].to_numpy(dtype=np.int64)] = rows["value"].to_numpy(dtype=float)
    return out


def _count_odds(views: dict, widths: dict, moments: bool):
    """Adds documents by cell of their odds in each view, and sums and squares of the inputs if wanted."""
    def add(total, bucket, owner, meta, use):
        odds = _both_odds(views, bucket, owner, meta)
        at = 0
        for name in views:
            total[at:at + ODDS_CELLS] += np.bincount(_cell(odds[name][use]), minlength=ODDS_CELLS)
            at += ODDS_CELLS
        for name in views if moments else ():
            width = widths[name]
            for _, x in _blocks(name, bucket, owner, meta, use):
                total[at:at + width] += x.sum(axis=0)
                total[at + width:at + 2 * width] += (x * x).sum(axis=0)
            at += 2 * width

    return add


def _sum_picked(views: dict, widths: dict, cells: dict):
    """Adds, per view and class, what the documents say that the other view is sure of."""
    def add(total, bucket, owner, meta, use):
        odds = _both_odds(views, bucket, owner, meta)
        at = 0
        for name, other in (("text", "meta"), ("meta", "text")):
            by, (low, high), width = odds[other], cells[other], widths[name]
            cell = _cell(by)
            for value, chosen in ((0, (cell <= low) & (by < -1)), (1, (cell >= high) & (by > 1))):
                for part, x in _blocks(name, bucket, owner, meta, use & chosen):
                    p = _sigmoid(odds[name][part])
                    back, bend = p - value, p * (1 - p)
                    total[at:at + 3] += len(part), back.sum(), bend.sum()
                    total[at + 3:at + 3 + 3 * width] += np.concatenate([back @ x, bend @ x, bend @ (x * x)])
                at += 3 + 3 * width

    return add


def _edges(counts: np.ndarray, low: float, high: float) -> tuple[int, int]:
    """The last cell of the ``low`` least odds and the first of the ``high`` greatest, whole cells."""
    last = int(np.searchsorted(np.cumsum(counts), low)) if low > 0 else -1
    first = ODDS_CELLS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), high)) if high > 0 else ODDS_CELLS
    return last, first


def _picked_slopes(sums: np.ndarray, width: int, mean: np.ndarray, scale: np.ndarray) -> tuple[tuple, float]:
    """Slopes and curvatures for scaled inputs, both classes alike, and the number of picked documents."""
    g, gb, h, hb, number = np.zeros(width), 0.0, np.zeros(width), 0.0, 0.0
    for part in sums.reshape(2, -1):
        n, back, bend = part[:3]
        if n == 0:
            continue
        back_x, bend_x, bend_xx = part[3:].reshape(3, width)
        g += 0.5 / n * scale * (back_x - mean * back)
        h += 0.5 / n * scale ** 2 * (bend_xx - 2 * mean * bend_x + mean ** 2 * bend)
        gb, hb, number = gb + 0.5 / n * back, hb + 0.5 / n * bend, number + n
    return (g, gb, np.maximum(h, 0), hb), number


def co_train(docs: DataFrame, known: np.ndarray, inputs: dict, label: np.ndarray, rounds: int = ROUNDS) -> QualityModel | None:
    """Fit both views on labelled rows ``inputs`` and all other documents of ``docs``.

    None without labelled rows of both classes.  In each round two passes over the
    corpus count the odds of both views and sum over the documents they are sure of.
    """
    rows = np.arange(len(label))
    held = rows[4::5]
    fit = np.setdiff1d(rows, held)
    if len(np.unique(label[fit])) < 2:
        return None
    share = (label[fit] == 1).mean()
    y = label[fit].astype(float)
    views = {name: _fit(x[fit], y) for name, x in inputs.items()}
    widths = {name: x.shape[1] for name, x in inputs.items()}
    scales: dict[str, tuple] = {}
    for turn in range(1, rounds + 1):
        size = 2 * ODDS_CELLS + (0 if scales else 2 * sum(widths.values()))
        sums = _corpus_sums(docs, known, size, _count_odds(views, widths, not scales))
        total = sums[:ODDS_CELLS].sum()
        if total == 0:
            break
        if not scales:
            at = 2 * ODDS_CELLS
            for name, width in widths.items():
                mean, square = sums[at:at + 2 * width].reshape(2, width) / total
                deviation = np.sqrt(np.maximum(square - mean ** 2, 0))
                scales[name] = mean, np.where(deviation < 1e-9, 0.0, 1 / np.maximum(deviation, LEAST_DEVIATION[name]))
                at += 2 * width
        count = max(2.0, turn * ROUND_SHARE * total)
        # Only what a view is sure of, in the proportions of the labels.
        cells = {name: _edges(sums[k * ODDS_CELLS:(k + 1) * ODDS_CELLS], count * (1 - share), count * share)
                 for k, name in enumerate(views)}
        found = _corpus_sums(docs, known, sum(2 * (3 + 3 * width) for width in widths.values()), _sum_picked(views, widths, cells))
        at, new = 0, {}
        for name, width in widths.items():
            picked, number = _picked_slopes(found[at:at + 2 * (3 + 3 * width)], width, *scales[name])
            at += 2 * (3 + 3 * width)
            # Picked documents weigh as much as labelled ones up to a share that grows with the rounds.
            weight = min(number / len(fit), turn * ROUND_SHARE)
            new[name] = _refit(views[name], inputs[name][fit], y, *scales[name], picked, weight) if number else views[name]
        views = new
    check = held if len(np.unique(label[held])) == 2 else fit
    for name, x in inputs.items():
        _calibrate(views[name], x[check], label[check])
    return QualityModel(views["text"], views["meta"])


def _frame(docs: DataFrame) -> DataFrame:
    return ready_workers(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"),
        F.col("text").cast("binary").alias("text"))


def training_sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS) -> DataFrame:
    """``(doc_id, label, buckets, counts, meta)`` of at most ``labelled`` documents.

    Ids with the smallest hashes are drawn before any text is read.  An id labelled
    both ways goes by majority, a tie leaves it out; of rows with the same id one is taken.
    """
    rank = F.xxhash64(F.col("doc_id"), F.lit(23))
    voted = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.avg("quality").alias("vote")).where("vote <> 0.5")
             .select("doc_id", (F.col("vote") > 0.5).cast("int").alias("label")))
    chosen = voted.orderBy(rank, "doc_id").limit(labelled)
    # At most ``labelled`` rows of two numbers.
    texts = _frame(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "source", "n_chars", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts, meta = [], [], []
            lang, source, chars = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for i, text in enumerate(batch.column(4)):
                data = np.frombuffer(text.as_py() or b"", dtype=np.uint8)
                offsets = np.array([0, len(data)])
                found, number = np.unique(text_buckets(data, offsets)[0], return_counts=True)
                buckets.append(found.astype(np.int32))
                counts.append(number.astype(np.int32))
                meta.append(metadata(lang[i:i + 1], source[i:i + 1], chars[i:i + 1], layout(data, offsets))[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
                 pa.array(meta, pa.list_(pa.float64()))], ["doc_id", "label", "buckets", "counts", "meta"])

    rows = texts.mapInArrow(run, "doc_id long, label int, buckets array<int>, counts array<int>, meta array<double>")
    return rows.dropDuplicates(["doc_id"])


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS) -> QualityModel | None:
    """A model from a bounded labelled sample and all other documents; None if the labels do not hold both classes."""
    rows = sorted(training_sample(docs, labels, labelled).collect(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    text = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        if len(r["buckets"]):
            number = np.asarray(r["counts"], dtype=float)
            text[i, np.asarray(r["buckets"])] = number / number.sum()
    inputs = {"text": text, "meta": np.array([r["meta"] for r in rows])}
    return co_train(docs, np.array([r["doc_id"] for r in rows], dtype=np.int64), inputs, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)`` for every row of ``docs``.

    Scores are calibrated probabilities of good quality by each view and combined;
    ``keep`` is a combined score of at least ``threshold``.  A null or empty text has
    no content: its scores are 0 and it is not kept.  Null metadata is a value of its
    own.  Without a model (no labels of both classes) scores of texts are 0.5 and all
    are kept.  Repeated rows stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            text_odds, meta_odds, full = np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
            lang, source, chars = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for low, high, data, offsets in W.chunks(batch.column(4)):
                full[low:high] = np.diff(offsets) > 0
                if model is None:
                    continue
                bucket, owner = text_buckets(data, offsets)
                mean = _text_mean(model.text.weights, bucket, owner, high - low)
                text_odds[low:high] = model.text.slope * (mean + model.text.bias) + model.text.shift
                meta_odds[low:high] = model.meta.odds(
                    metadata(lang[low:high], source[low:high], chars[low:high], layout(data, offsets)))
            both = _sigmoid(0.5 * (text_odds + meta_odds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.where(full, x, 0.0)) for x in (_sigmoid(text_odds), _sigmoid(meta_odds), both)),
                 pa.array(full & (both >= threshold))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return _frame(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
