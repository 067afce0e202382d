"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is trained by stochastic gradient descent in NumPy on a bounded sample of
labelled rows; every document is then scored by Spark tasks on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from colweave.llm import words as W
from colweave.session import materialise, ready_workers

BUCKETS = 1 << 14
SUBWORD_BYTES = (2, 3, 4)
DIMENSIONS = 16
# Bound of the labelled sample: rows per language, the ones with the smallest hashes.
SAMPLE_ROWS_PER_LANGUAGE = 400
# Share of held-back sample documents of a right prediction that may be rejected.
REJECTED_SHARE = 0.001
UNDETERMINED = "und"
HAS_LETTER = r"\p{L}"

# Letters are A-Z, a-z and everything outside ASCII; the rest separates words.
_LETTERS = W._table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, document)`` of every subword: runs of bytes within a word, with its edges marked."""
    data = W.LOWER[data]
    code = np.where(_LETTERS[data], data, 0x20).astype(np.uint32)
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A space before and after every document ends its words.
    sizes = np.diff(offsets)
    padded = np.full(n + 2 * len(sizes), 0x20, dtype=np.uint32)
    document = np.repeat(np.arange(len(sizes)), sizes + 2)
    padded[np.arange(n) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = code
    blank = padded == 0x20
    gaps = np.cumsum(blank)
    buckets, owners = [], []
    for length in SUBWORD_BYTES:
        m = len(padded) - length + 1
        if m <= 0:
            continue
        h = np.full(m, length, dtype=np.uint32)
        for j in range(length):
            h = (h ^ padded[j:j + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        # No blank inside, and not blanks alone.
        inner = gaps[length - 2:length - 2 + m] - gaps[:m] if length > 2 else np.zeros(m, dtype=np.int64)
        good = (inner == 0) & ~(blank[:m] & blank[length - 1:]) & (document[:m] == document[length - 1:])
        if length == 2:
            good &= ~(blank[:m] | blank[length - 1:])
        at = np.flatnonzero(good)
        buckets.append((h[at] % np.uint32(BUCKETS)).astype(np.int64))
        owners.append(document[at])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    """``scores`` is embeddings times softmax weights: averaging and the linear layer commute."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits ``(documents, languages)`` and the number of subwords of each document."""
        count = len(offsets) - 1
        bucket, owner = subwords(data, offsets)
        number = np.bincount(owner, minlength=count)
        sums = np.stack([np.bincount(owner, weights=self.scores[:, k][bucket], minlength=count)
                         for k in range(len(self.languages))], axis=1)
        return sums / np.maximum(number, 1)[:, None] + self.bias, number

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its calibrated probability."""
        logits, _ = self.logits(data, offsets)
        p = _softmax(logits / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS_PER_LANGUAGE) -> DataFrame:
    """``(lang, buckets, counts)`` of at most ``rows`` documents of each language.

    The distinct documents with the smallest hashes of id and text are taken; each is
    its whole text as a histogram over ``BUCKETS``, bounded however long the text is.
    """
    known = (docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(HAS_LETTER))
             .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"),
                     F.xxhash64(F.col("doc_id").cast("string"), "text").alias("rank")))
    # A limit on the hash keeps about twice the rows wanted; the exact cut is made below.
    share = F.lit(2.0 * (rows + 50)) / F.col("count")
    limit = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((F.lit(-(2.0 ** 63)) + share * F.lit(2.0 ** 64)).cast("long"))
    # One row a language, so texts need no shuffle to meet them while these are known to be few.
    edge = materialise(known.groupBy("lang").count().select(F.col("lang").alias("edge_lang"), limit.alias("edge")))
    texts = known.join(edge, F.col("lang") == F.col("edge_lang")).where("rank <= edge").select("lang", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for text in batch.column(2):
                data = np.frombuffer(text.as_py(), dtype=np.uint8)
                bucket, _ = subwords(data, np.array([0, len(data)]))
                found, number = np.unique(bucket, return_counts=True)
                ids.append(found.astype(np.int32))
                counts.append(number.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["lang", "rank", "buckets", "counts"])

    found = ready_workers(texts).mapInArrow(run, "lang string, rank long, buckets array<int>, counts array<int>")
    # Copies of a row share its rank and count once, so a language's window sees about twice ``rows`` rows.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    return found.dropDuplicates(["lang", "rank"]).withColumn("place", place).where(F.col("place") <= rows).drop("place")


def train(sample: list, epochs: int = 8, rate: float = 0.5, seed: int = 3) -> LanguageModel:
    """Fit on the bounded sample; a fifth of it calibrates the temperature and the rejection.

    With no labelled rows the model has the single language ``und``.
    """
    sample = sorted(sample, key=lambda r: (r["rank"], r["lang"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return LanguageModel([UNDETERMINED], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    number = {name: k for k, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out = np.zeros((DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    rows = [(np.asarray(r["buckets"], dtype=np.int64), np.asarray(r["counts"], dtype=float), number[r["lang"]])
            for r in sample if len(r["buckets"])]
    rows = [(b, c / c.sum(), k) for b, c, k in rows]
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            bucket, share, k = fit[i]
            mean = share @ emb[bucket]
            p = _softmax((mean @ out + bias)[None])[0]
            p[k] -= 1.0
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.01 * step * p
            # The average's gradient reaches each bucket by its share; scaled up as most shares are small.
            emb[bucket] -= (step * 10.0 * share)[:, None] * back[None]
    model = LanguageModel(languages, emb @ out, bias, 1.0, 0.0)
    check = held or fit
    if check and len(languages) > 1:
        z = np.array([share @ model.scores[bucket] + bias for bucket, share, _ in check])
        truth = np.array([k for _, _, k in check])
        grid = np.geomspace(1.0, 20.0, 40)  # never sharper than trained
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        if len(right):
            # Half way from chance to the score that all but REJECTED_SHARE of the right ones reach.
            chance = 1 / len(languages)
            model.reject_below = float(chance + 0.5 * max(0.0, np.quantile(right, REJECTED_SHARE) - chance))
    return model


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS_PER_LANGUAGE) -> LanguageModel:
    """A model of the languages in ``lang``, from a bounded sample of the labelled rows of ``docs``."""
    return train(labelled_sample(docs, rows).collect())


def identify(docs: DataFrame, model: LanguageModel, keep: list[str | Column] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``) with ``lang_pred``, ``score`` and ``rejected``.

    Only the text is an input of a prediction.  A null text, or one without letters,
    is ``und`` with score 0 and rejected.  Others get a learned language; ``rejected``
    tells that its calibrated probability is below the model's limit.  Whole texts
    of any length are read, repeated rows stay.
    """
    kept = [F.col(c) if isinstance(c, str) else c for c in (keep if keep is not None else ["doc_id"])]
    frame = ready_workers(docs).select(*kept, F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)).alias("_has_letter"),
                                       F.col("text").cast("binary").alias("_text_bytes"))
    names = frame.columns[:-2]
    languages = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, width = batch.num_rows, batch.num_columns
            best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
            for low, high, data, offsets in W.chunks(batch.column(width - 1)):
                best[low:high], score[low:high] = model.predict(data, offsets)
            letters = batch.column(width - 2).to_numpy(zero_copy_only=False)
            labels = np.where(letters, languages[best], UNDETERMINED)
            score = np.where(letters, np.clip(score, 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width - 2], pa.array(labels, pa.string()), pa.array(score),
                 pa.array(~letters | (score < model.reject_below))], [*names, "lang_pred", "score", "rejected"])
        W.release()

    schema = StructType([*frame.schema.fields[:-2], StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return frame.mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows that :func:`identify` rejects; columns unchanged."""
    frame = ready_workers(docs).withColumn("_has_letter_of_text", F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)))
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.array(batch.column(len(names)).to_numpy(zero_copy_only=False), dtype=bool)
            for low, high, data, offsets in W.chunks(batch.column(text)):
                kept[low:high] &= model.predict(data, offsets)[1] >= model.reject_below
            yield pa.RecordBatch.from_arrays(batch.columns[:len(names)], names).filter(pa.array(kept))
        W.release()

    return frame.mapInArrow(run, docs.schema)
