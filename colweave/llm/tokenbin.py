"""Token ids as fixed-width bit-packed binary shards.

A shard holds the ids of documents that follow each other in ascending doc_id order.
Every id takes the minimum bits of the vocabulary.  Layout, all numbers little-endian:

    magic (8 bytes)
    blocks: ``block_ids`` ids each (the last one fewer), packed lowest bit first
    per document: doc_id int64, valid uint8, number of ids int64 (three arrays)
    per block: byte offset uint64 (array)
    footer: bits, block_ids, ids, documents, blocks as uint64; magic

Block offsets give random access: an id's block is its place divided by ``block_ids``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm import store
from colweave.llm import words as W
from colweave.session import materialise, ready_workers

MAGIC = b"CWPACK01"
BLOCK_IDS = 1 << 16
END_ID = 2
# Pieces a worker remembers; as many that were used before those are kept beside them.
CACHE_PIECES = 400_000
WORDS_PER_TEXT = 512
# Characters that go to the tokenizer at once; its encodings take many times as much.
ENCODED_CHARS = 1 << 15
# Texts are encoded in groups of about this many bytes, in which each distinct piece is looked up once.
TEXT_BYTES = 4 << 20
# One word to any tokenizer that keeps letters together: ASCII letters and the letters of Latin-1.
ONE_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
_CLOSING = np.isin(np.arange(256), list(b".,;:!?|)\"]}"))
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_LETTER_OR_DIGIT = np.array([bytes([b]).isalnum() for b in range(256)])
_FOOTER = struct.Struct("<5Q8s")


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids packed to ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(flat.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The inverse of :func:`pack` as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    """Streams ids into a shard; holds one open block and the document table."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        stream.write(MAGIC)
        self.place = len(MAGIC)
        self.open: list[np.ndarray] = []
        self.held = self.ids = 0
        self.doc_ids: list[int] = []
        self.valid: list[int] = []
        self.lengths: list[int] = []
        self.offsets: list[int] = []

    def _emit(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.place)
        self.stream.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_many([doc_id], ids, np.array([len(ids)]))

    def add_many(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents whose ids follow each other in ``ids``."""
        self.doc_ids += [x or 0 for x in doc_ids]
        self.valid += [x is not None for x in doc_ids]
        self.lengths += lengths.tolist()
        self.ids += len(ids)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            joined = np.concatenate(self.open)
            whole = len(joined) // self.block_ids * self.block_ids
            for low in range(0, whole, self.block_ids):
                self._emit(joined[low:low + self.block_ids])
            self.open, self.held = [joined[whole:]], len(joined) - whole

    def close(self) -> None:
        if self.held:
            self._emit(np.concatenate(self.open))
        self.stream.write(np.array(self.doc_ids, dtype="<i8").tobytes() + np.array(self.valid, dtype="u1").tobytes()
                          + np.array(self.lengths, dtype="<i8").tobytes() + np.array(self.offsets, dtype="<u8").tobytes())
        self.stream.write(_FOOTER.pack(self.bits, self.block_ids, self.ids, len(self.doc_ids), len(self.offsets), MAGIC))
        self.stream.close()


class ShardReader:
    """Reads a shard: its document table at once, ids block by block or by range."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        self.bits, self.block_ids, self.ids, docs, blocks, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a packed token shard")
        tail = 17 * docs + 8 * blocks
        self.end = size - _FOOTER.size - tail
        source.seek(self.end)
        raw = source.read(tail)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.valid = np.frombuffer(raw, "u1", docs, 8 * docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.offsets = np.frombuffer(raw, "<u8", blocks, 17 * docs)

    def block(self, number: int) -> np.ndarray:
        """The ids of one block."""
        low = int(self.offsets[number])
        high = int(self.offsets[number + 1]) if number + 1 < len(self.offsets) else self.end
        self.source.seek(low)
        count = min(self.block_ids, self.ids - number * self.block_ids)
        return unpack(self.source.read(high - low), self.bits, count)

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on; only their blocks are read."""
        if count <= 0:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        ids = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[start - first * self.block_ids:][:count]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """``(doc_id, start, n_ids, crc32)`` per document, one block in memory at a time."""
        place, number, held, low = 0, -1, np.zeros(0, dtype="<u4"), 0
        for doc_id, valid, length in zip(self.doc_ids.tolist(), self.valid.tolist(), self.lengths.tolist()):
            crc, at, stop = 0, place, place + length
            while at < stop:
                if at >= low + len(held):
                    number = at // self.block_ids
                    held, low = self.block(number).astype("<u4"), number * self.block_ids
                upto = min(stop, low + len(held))
                crc = zlib.crc32(memoryview(held[at - low:upto - low]).cast("B"), crc)
                at = upto
            yield (doc_id if valid else None), place, length, crc
            place = stop


class PieceEncoder:
    """Encodes texts piece by piece between ASCII white space, remembering pieces.

    Right for tokenizers that lower-case, drop white space and never join text across
    it, nor letters and punctuation, as ``word_bpe_49k.json`` does; others take
    ``pieces=False`` and encode whole texts.  The library encodes each piece once
    while it is remembered; pieces that were not used lately are forgotten.
    """

    def __init__(self, path: str, pieces: bool = True, remembered: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = pieces
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def forget(self) -> None:
        """Drop the remembered pieces."""
        self.known, self.older = {}, {}

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        low = held = 0
        for high, text in enumerate(texts, 1):
            held += len(text)
            if held >= ENCODED_CHARS or high == len(texts):
                for found in self.tokenizer.encode_batch_fast(texts[low:high], add_special_tokens=False):
                    yield np.array(found.ids, dtype="<u4")
                low, held = high, 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self._encoded(texts)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces that are one word each: many go in one text, and end-of-word ids part them."""
        out: list[bytes] = []
        groups = [words[i:i + WORDS_PER_TEXT] for i in range(0, len(words), WORDS_PER_TEXT)]
        texts = [b" ".join(group).decode() for group in groups]
        for group, ids in zip(groups, self._encoded(texts)):
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                out += [raw[low:high] for low, high in zip([0, *ends], ends)]
            else:
                out += self._whole([w.decode() for w in group])
        return out

    def _encode_new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        single = [w for w in pieces if self.ends_word is not None and ONE_WORD.match(w)]
        other = list(set(pieces).difference(single))
        return dict(zip(single + other, self._words(single) + self._whole([w.decode() for w in other])))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, encoding those that are not remembered."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = []
        for word in words:
            if word not in known:
                ids = older.get(word)
                if ids is None:
                    fresh.append(word)
                else:
                    known[word] = ids
        known.update(self._encode_new(fresh))
        return [*map(known.__getitem__, words)]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in ``data``, ``end_id`` after each, and how many each has."""
        docs = len(offsets) - 1
        end = np.array([end_id], dtype="<u4").tobytes()
        if not self.pieces:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            found = [ids + end for ids in self._whole(texts)]
            return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(ids) // 4 for ids in found], dtype=np.int64)
        start, stop, inside = _pieces(data, offsets)
        core, lowered = _cores(data, start, stop)
        # A document is its pieces, each a word and perhaps the punctuation after it, and the end id.
        tail = np.flatnonzero(core < stop)
        length = stop[tail] - core[tail]
        closing = np.repeat(core[tail] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        tails, tail_at = _distinct(data[closing], length)
        inside[closing] = False
        words, word_at = _distinct(lowered[inside], core - start)
        ids = [*self._ids(words), *self._ids(tails), end]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        first = np.searchsorted(start, offsets)
        before = np.arange(len(start)) + np.repeat(np.arange(docs), np.diff(first))  # units but tails
        has_tail = np.zeros(len(start) + 1, dtype=np.int64)
        has_tail[tail + 1] = 1
        tails_before = np.cumsum(has_tail)
        code = np.full(len(start) + docs + len(tail), len(ids) - 1, dtype=np.int64)
        place = before + tails_before[:-1]
        code[place] = word_at
        code[place[tail] + 1] = len(words) + tail_at
        many = size[code]
        upto = np.cumsum(many)
        out = flat[np.repeat((np.cumsum(size) - size)[code] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        ends = upto[first[1:] + np.arange(docs) + tails_before[first[1:]]]
        return out, np.diff(ends, prepend=0)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces between white space begin and end, and their bytes; none goes over the end of a text."""
    inside = W.SPACED[data]
    opens, closes = inside.copy(), inside.copy()
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True
    opens[1:] &= ~inside[:-1] | edges[1:-1]
    closes[:-1] &= ~inside[1:] | edges[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1, inside


def _cores(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece's word ends, and ``data`` with the pieces in lower case where that is safe.

    The tokenizer composes before it lower-cases, so only pieces wholly of ASCII are
    lower-cased here; the texts of special tokens, told apart by case, stay as they are
    and are not split.
    """
    wide = np.flatnonzero(data >= 0x80)
    plain = np.searchsorted(wide, start) == np.searchsorted(wide, stop)
    marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else wide
    special = np.searchsorted(marks, start) < np.searchsorted(marks, stop - 1)
    capital = np.flatnonzero(_CAPITAL[data])
    lowered = data.copy()
    lowered[capital[(plain & ~special)[np.searchsorted(start, capital, side="right") - 1]]] += 32
    # The last byte that is no closing punctuation.
    solid = np.flatnonzero(~_CLOSING[data])
    last = np.searchsorted(solid, stop) - 1
    at = solid[np.maximum(last, 0)] if len(solid) else np.zeros(len(start), dtype=np.int64)
    cut = (last >= 0) & (at >= start) & ~special
    cut[cut] &= _LETTER_OR_DIGIT[data[at[cut]]]
    return np.where(cut, at + 1, stop), lowered


def _distinct(data: np.ndarray, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct among the byte strings of these lengths, and which of them each is."""
    places = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(places), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str, pieces: bool, remembered: int) -> PieceEncoder:
    return PieceEncoder(path, pieces, remembered)


def _write(folder: str, path: str, pieces: bool, vocabulary: int, end_id: int, block_ids: int, text_bytes: int, remembered: int,
           keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = uri = None
        for batch in batches:
            data, offsets = W.binary_parts(batch.column(1))
            ids = batch.column(0).to_pylist()
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + text_bytes, side="right")) - 1)
                if writer is None:
                    stream, uri = store.open_output(folder, store.attempt_name("shard", ".bin"))
                    writer = ShardWriter(stream, id_bits(vocabulary), block_ids)
                writer.add_many(ids[low:high], *_encoder(path, pieces, remembered).encode(
                    data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], end_id))
                low = high
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [TaskContext.get().partitionId()], "uri": [uri], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.ids]},
                pa.schema([("shard", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            if not keep:
                # The words alone: a tokenizer that is loaded again takes more memory each time.
                _encoder(path, pieces, remembered).forget()
        W.release()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, pieces: bool = True,
                 end_id: int = END_ID, shards: int | None = None, block_ids: int = BLOCK_IDS,
                 text_bytes: int = TEXT_BYTES, remembered: int = CACHE_PIECES, keep: bool = True) -> DataFrame:
    """Encode whole texts, append ``end_id``, write shards; the written manifest comes back.

    Manifest: ``(shard, uri, n_docs, n_ids, start)``, ``start`` being the ids of all
    shards before.  Documents follow in ascending doc_id order, null ids first; rows
    of the same id in the order of their texts' hashes.  A null or empty text is the
    end id alone.  Other columns are ignored, repeated rows stay.  No documents give an
    empty manifest.

    Ranges of (doc_id, text hash) are dealt over ``shards`` tasks (default
    ``spark.sql.shuffle.partitions``), so many rows of one id spread too.  A shard is
    named in the manifest only when its task has ended; files of lost attempts are
    never read.

    ``text_bytes`` and ``remembered`` trade memory of a worker for time: groups of texts
    whose distinct words are looked up once, and words whose ids are kept.  Without ``keep``
    the words go when a task ends, so that a worker's next task, of whatever kind, does
    not stand on top of them.
    """
    spark = docs.sparkSession
    folder = folder or store.new_folder(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from tokenizers import Tokenizer
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                        F.xxhash64("text").alias("text_key"))
    dealt = (ready_workers(texts).repartitionByRange(shards, "doc_id", "text_key")
             .sortWithinPartitions("doc_id", "text_key").select("doc_id", "text"))
    manifest = materialise(dealt.mapInArrow(_write(folder, tokenizer_path, pieces, vocabulary, end_id, block_ids, text_bytes, remembered, keep),
                                            "shard long, uri string, n_docs long, n_ids long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))


def read_documents(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, read back from the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input(uri) as source:
                    rows = list(ShardReader(source).documents())
                ids, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.array(start, dtype=np.int64) + base),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (ready_workers(manifest).select("uri", "start").repartition(tasks)
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def read_range(manifest: DataFrame, start: int, count: int) -> np.ndarray:
    """``count`` ids from the global place ``start`` on: random access for a data loader."""
    touched = (manifest.where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))
               .orderBy("start").collect())
    parts = []
    for row in touched:
        with store.open_input(row["uri"]) as source:
            low = max(0, start - row["start"])
            parts.append(ShardReader(source).read(low, min(row["n_ids"], start + count - row["start"]) - low))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
