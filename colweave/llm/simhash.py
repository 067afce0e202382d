"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the limit have
one segment that differs by at most one bit.  Every segment is indexed once per bit
with that bit wiped (a one-wildcard variant), variants are equality-joined, and the
documents that meet are verified on whole fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm import words as W
from colweave.llm.components import components
from colweave.session import materialise, ready_workers

# Variants with more members are compared in blocks of this many.
BLOCK_ROWS = 2048
HASH_SEED = 42


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, for rows of 64-bit hashes ``(n, k)``: ``64 * k`` counts."""
    rows = hashes.reshape(len(hashes), -1)
    total = np.zeros(rows.shape[1] * 64, dtype=np.int64)
    for low in range(0, len(rows), 255 * 64):
        part = np.ascontiguousarray(rows[low:low + 255 * 64])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        # Up to 255 bits add up within a byte; only the sums are widened.
        whole = len(bits) // 255 * 255
        if whole:
            total += np.add.reduce(bits[:whole].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return total


def majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of hashes ``(n, k)``: ``k`` words, a bit set where over half have it."""
    if len(hashes) == 0:
        return np.zeros(hashes.shape[1] if hashes.ndim > 1 else 1, dtype=np.uint64)
    return np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)


def text_fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the XXH64 hashes of all shingles of ``shingle`` words, repeats included.

    Fewer words make one shingle of all of them; no words give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(majority(np.array([[xxhash.xxh64_intdigest(joined, HASH_SEED)]], dtype=np.uint64))[0])
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    hashes = [digest(joined[s:e - 1], seed) for s, e in zip(starts, ends[shingle - 1:].tolist())]
    return int(majority(np.array(hashes, dtype=np.uint64).reshape(-1, 1))[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: one row per document with its fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((text_fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)),
                                 dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])
        W.release()

    texts = ready_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of linked rows ``i``, ``j``; ``label`` points to the first row of a class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def link_units(unit: np.ndarray, prints: np.ndarray, limit: int) -> np.ndarray:
    """For each row the first row of its class, among rows of the same unit (units are runs).

    Rows link where their prints ``(n, k)`` differ by at most ``limit`` bits.
    """
    n = len(unit)
    label = np.arange(n)
    if n == 0:
        return label
    cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    end = np.repeat(np.r_[cut[1:], n], np.diff(np.r_[cut, n]))
    active = np.arange(n)
    step = 1
    while True:
        active = active[active + step < end[active]]
        if len(active) == 0:
            return label
        left = active[label[active] != label[active + step]]
        differ = np.bitwise_count(prints[left] ^ prints[left + step]).sum(axis=1)
        near = left[differ <= limit]
        if len(near):
            label = _settle(label, near, near + step)
        step += 1


def _link_runs(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(unit, node, prints):
            label = link_units(unit, prints, limit)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            unit = batch.column(0).to_numpy(zero_copy_only=False)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            data, _ = W.binary_parts(batch.column(2))
            held.append((unit, node, data.view(np.uint64).reshape(len(unit), -1)))
            unit, node, prints = (np.concatenate(x) for x in zip(*held))
            # The last unit may go on in the next batch.
            last = len(unit) - int(np.argmax(np.r_[unit[::-1] != unit[-1], True]))
            if last:
                yield solve(unit[:last], node[:last], prints[:last])
            held = [(unit[last:], node[last:], prints[last:])]
        if held:
            yield solve(*held[0])
        W.release()

    return run


def _met(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed(node, variant)`` whose variant others have too, with its ``count``."""
    # A count joined back would shuffle all variants twice.
    return keyed.withColumn("count", F.count("*").over(Window.partitionBy("variant"))).where("count > 1")


def variant_links(nodes: DataFrame, segment_bits: int, limit: int, block_rows: int = BLOCK_ROWS,
                  variant_tasks: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes whose prints differ by at most ``limit`` bits and share a variant.

    ``nodes``: ``node long``, ``segments array<long>`` of at most 32 bits each,
    ``print binary`` of whole 64-bit words.  Nodes must be distinct.  Within a
    variant only enough edges to join its classes come out, never all pairs, so a
    dense family costs rows in proportion to its members.  A variant with more than
    ``block_rows`` members is compared as pairs of blocks, which go to different tasks.
    Many variants a node go through one exchange into ``variant_tasks``, so that a task
    sorts few of them; by default their counts are joined back.
    """
    # A task makes many rows of each node, so nodes are dealt over as many tasks as the shuffle has.
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.repartition(n).select(
        "node",
        F.explode(F.flatten(F.expr(
            f"transform(segments, (s, k) -> transform(sequence(0, {segment_bits - 1}),"
            f" p -> shiftleft(cast(k * {segment_bits} + p as bigint), 32) | (s & ~shiftleft(1L, p))))"))).alias("variant"))
    # Only keys travel with the variants; prints join the few that meet.
    if variant_tasks:
        met = _met(keyed.repartition(variant_tasks, "variant"))
    else:
        met = keyed.join(keyed.groupBy("variant").count().where("count > 1"), "variant")
    met = met.select(
        "variant", "node", F.ceil(F.col("count") / block_rows).cast("long").alias("blocks"))
    own = F.expr("pmod(xxhash64(node), blocks)")
    dealt = met.withColumn("own", own).withColumn(
        "other", F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0L) ELSE"
                                  " filter(sequence(0L, blocks - 1), x -> x <> own) END")))
    units = dealt.select(
        F.xxhash64("variant", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "node")
    units = units.join(nodes.select("node", "print"), "node").select("unit", "node", "print")
    return (ready_workers(units).repartition(n, "unit").sortWithinPartitions("unit")
            .mapInArrow(_link_runs(limit), "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document.

    Documents link where their 64-bit fingerprints differ by at most ``limit`` bits;
    ``component_id`` is the smallest doc_id reachable over links.  The search is
    exact: 64 bits in ``limit // 2 + 1`` segments leave one segment with at most one
    differing bit.

    A null or empty text has fingerprint zero and links like any other.  Rows with
    a null doc_id get the component of their fingerprint (null if all its ids are
    null); repeated doc_ids stay one row each.  Other columns are ignored.
    """
    segments = limit // 2 + 1
    bits = math.ceil(64 / segments)
    if bits > 32:
        segments, bits = 2, 32
    prints = materialise(fingerprints(docs, shingle))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    cuts = [F.expr(f"shiftrightunsigned(fp, {k * bits}) & {(1 << min(bits, 64 - k * bits)) - 1}L") for k in range(segments)]
    nodes = distinct.select(F.col("fp").alias("node"), F.array(*cuts).alias("segments"),
                            F.expr("unhex(lpad(hex(fp), 16, '0'))").alias("print"))
    roots = materialise(components(variant_links(nodes, bits, limit)))
    classed = (distinct.join(roots, distinct.fp == roots.node, "left")
               .select("fp", "least_id", F.coalesce("root", "fp").alias("class")))
    # Most classes have one fingerprint; least ids are small rows, one per fingerprint.
    least = classed.groupBy("class").agg(F.min("least_id").alias("component_id"))
    labels = materialise(classed.join(least, "class").select("fp", "component_id"))
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity -------------------------------------------------------------

# 256-bit fingerprints over the set of shingles; nine segments of 28 bits make 252 one-wildcard variants.
PRINT_WORDS, SEGMENT_BITS, SEGMENTS = 4, 28, 9
_SEEDS = W.mix(np.arange(1, PRINT_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# What fingerprints of 0.8 miss is found by bands. Each band is a key of the least of BAND_ROWS orders of the shingles: sets of similarity s share
# one with probability 1 - (1 - s ** BAND_ROWS) ** BANDS, whatever kind of edit parts them.
# That is 0.9998 at 0.8, 0.38 at 0.5 and 0.002 at 0.2.
BAND_ROWS, BANDS = 6, 28
_ORDERS = W.mix(np.arange(1, 2 * BAND_ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).reshape(2, -1)
# Members of a band key that are compared with each other in one unit; their sets travel with them.
SET_BLOCK_ROWS = 512
# Text hashes of documents that met as a bit map of fixed size: 8 MB.
MAP_BITS = 1 << 26


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of shingle hashes, each of another band's least values; none for no shingles."""
    if len(shingles) == 0:
        return np.zeros(0, dtype=np.uint64)
    least = np.full(BAND_ROWS * BANDS, np.iinfo(np.uint64).max)
    for low in range(0, len(shingles), 256):
        part = (shingles[low:low + 256, None] ^ _ORDERS[0]) * (_ORDERS[1] | np.uint64(1))
        np.minimum(least, part.min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys


def _shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``shingle`` words; fewer words are one run."""
    for _, _, data, offsets in W.chunks(column):
        found = W.split(data, offsets, W.SPACED)
        hashes = found.hashes()
        spans = W.runs(hashes, shingle)
        for low, high in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            yield np.unique(spans[low:high - shingle + 1] if high - low >= shingle else
                            W.runs(hashes[low:high], max(1, high - low)))


def set_print(shingles: np.ndarray) -> bytes:
    """The SimHash of a set of shingle hashes, ``PRINT_WORDS`` words of 64 bits."""
    return majority(W.mix(shingles[:, None] ^ _SEEDS)).tobytes()


def bit_limit(similarity: float, bits: int = 64 * PRINT_WORDS, slack: float = 3.0) -> int:
    """Differing bits up to which prints are candidates for this Jaccard similarity.

    Sets of similarity s have cosine 2s / (1 + s) at equal sizes, and a bit differs with
    probability acos(cosine) / pi; ``slack`` standard deviations keep pairs at the edge.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def print_candidates(prints: DataFrame, similarity: float) -> DataFrame:
    """``(node, variant, count)``: nodes that SimHash puts together, ``variant`` being their component.

    ``prints``: ``(node, print)``, nodes distinct.  Nodes meet on a one-wildcard variant of a
    segment and stay together where whole prints differ by at most :func:`bit_limit` bits.
    """
    per = SEGMENT_BITS // 4
    cuts = [F.conv(F.substring(F.hex("print"), 1 + k * per, per), 16, 10).cast("long") for k in range(SEGMENTS)]
    nodes = prints.select("node", F.array(*cuts).alias("segments"), "print")
    tasks = 3 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = materialise(components(variant_links(nodes, SEGMENT_BITS, bit_limit(similarity), variant_tasks=tasks)))
    sizes = together.groupBy("root").count()
    return together.join(sizes, "root").select("node", F.col("root").alias("variant"), "count")


def _prints_and_keys(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, digests = [], [], []
            for own in _shingle_sets(batch.column(2), shingle):
                prints.append(set_print(own))
                keys.append(band_keys(own).view(np.int64))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(digests, pa.binary())], ["doc_id", "text_key", "print", "keys", "digest"])
        W.release()

    return run


def _wanted_sets(shingle: int, held):
    """Sets of the texts whose hash is on the bit map; a few others come along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(MAP_BITS - 1)
            hit = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            wanted = batch.column(1).filter(pa.array(hit))
            sets = [own.tobytes() for own in _shingle_sets(wanted, shingle)]
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(hit)), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()),
                     pa.array(sets, pa.binary())], ["text_key", "digest", "shingles"])
        W.release()

    return run


def _bit_map(keys: DataFrame) -> np.ndarray:
    """``keys(text_key)`` as bits; at most ``MAP_BITS / 64`` rows of two numbers reach the driver."""
    place = F.expr(f"text_key & {MAP_BITS - 1}L")
    cells = (keys.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, cast(text_key & 63 as int))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    out[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def link_sets(group: np.ndarray, sets: list[bytes], similarity: float) -> np.ndarray:
    """For each row of a unit the first row of its class; rows of equal ``group`` are one class already.

    Two rows link where the Jaccard similarity of their sets (sorted distinct 64-bit
    hashes) is at least ``similarity``.  Pairs within a class are not compared.
    """
    n = len(group)
    _, first, place = np.unique(group, return_index=True, return_inverse=True)
    label = first[place]
    size = np.array([len(x) // 8 for x in sets])
    known: dict[int, frozenset] = {}

    def members(i: int) -> frozenset:
        if i not in known:
            known[i] = frozenset(np.frombuffer(sets[i], dtype=np.uint64).tolist())
        return known[i]

    for step in range(1, n):
        left = np.flatnonzero(label[:-step] != label[step:])
        if len(left) == 0:
            if label.max() == 0:
                break
            continue
        # The smaller set's share of the larger bounds the similarity.
        few, many = np.minimum(size[left], size[left + step]), np.maximum(size[left], size[left + step])
        near = []
        for i in left[few >= similarity * many - 1e-6].tolist():
            shared = len(members(i) & members(i + step))
            if shared / max(1, int(size[i] + size[i + step]) - shared) >= similarity:
                near.append(i)
        if near:
            label = _settle(label, np.array(near), np.array(near) + step)
    return label


def _link_set_runs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, node, group, sets = None, [], [], []

        def solve():
            label = link_sets(np.array(group), sets, similarity)
            moved = np.flatnonzero(label != np.arange(len(label)))
            held = np.array(node)
            return pa.RecordBatch.from_arrays([pa.array(held[moved]), pa.array(held[label[moved]])], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if row[0] != unit:
                    if len(node) > 1:
                        yield solve()
                    unit, node, group, sets = row[0], [], [], []
                node.append(row[1])
                group.append(row[2])
                sets.append(row[3])
        if len(node) > 1:
            yield solve()
        W.release()

    return run


def _links_in_units(units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges ``(a, b)`` within ``units(unit, node, class)``, decided on ``sets(node, shingles)``."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Units of the same members are compared once; two hashes stand for the members.
    kinds = units.groupBy("unit").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"),
        (F.min("class") != F.max("class")).alias("open")).where("open AND size > 1")
    chosen = kinds.groupBy("size", "x", "y").agg(F.min("unit").alias("unit")).select("unit")
    rows = units.join(chosen, "unit").join(sets, "node").select("unit", "node", "class", "shingles")
    return (ready_workers(rows).repartition(n, "unit").sortWithinPartitions("unit", "node")
            .mapInArrow(_link_set_runs(similarity), "a long, b long"))


def set_links(keyed: DataFrame, sets: DataFrame, similarity: float, block_rows: int = SET_BLOCK_ROWS,
              known: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of all that links among nodes that share a key: ``keyed(node, variant, count)``.

    ``known(node, root)`` are classes found before; they go on, and no pair within one is compared.

    First each key's members link within blocks of about ``block_rows``; a family is
    mostly joined then, so only pairs of blocks that still hold several classes are
    compared after it.  Every link is decided on the whole sets.
    """
    blocks = keyed.withColumn("blocks", F.ceil(F.col("count") / block_rows).cast("long")).withColumn(
        "own", F.expr("pmod(xxhash64(node, variant), blocks)"))
    if known is None:
        blocks = blocks.withColumn("class", F.col("node"))
    else:
        blocks = blocks.join(known, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    once = blocks.select(F.xxhash64("variant", "own").alias("unit"), "node", "class")
    first = _links_in_units(once, sets, similarity)
    first = materialise(first if known is None else first.unionAll(known.toDF("a", "b")))
    roots = materialise(components(first))
    wide = blocks.where("blocks > 1").drop("class").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    held = materialise(wide.select("variant", "node", "class", "blocks", "own"))
    # Keys of one class are done.
    open_keys = held.groupBy("variant").agg((F.min("class") != F.max("class")).alias("open")).where("open").select("variant")
    left = materialise(held.join(open_keys, "variant"))
    if left.limit(1).count() == 0:
        return roots
    # Blocks as sorted pairs; a pair whose members are all of one class needs no comparing.
    spans = left.groupBy("variant", "own").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    a, b = (spans.select("variant", *[F.col(c).alias(f"{side}_{c}") for c in ("own", "low", "high")]) for side in "ab")
    pairs = a.join(b, "variant").where("a_own < b_own AND (a_low <> a_high OR b_low <> b_high OR a_low <> b_low)")
    dealt = pairs.select("variant", F.xxhash64("variant", "a_own", "b_own").alias("unit"),
                         F.explode(F.array("a_own", "b_own")).alias("own"))
    units = left.join(dealt, ["variant", "own"]).select("unit", "node", "class")
    return materialise(components(first.unionAll(_links_in_units(units, sets, similarity))))


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, text_key, group, keep)``: near copies by SimHash at a shingle similarity.

    Candidates are the :func:`print_candidates` of the fingerprints over the sets of
    ``shingle``-word shingles; they link where the Jaccard similarity of these sets (of
    64-bit hashes) is at least ``similarity``.  Fingerprints miss links near 0.8, so pairs
    not in one class by then that share one of the :func:`band_keys` are decided too.

    Groups are components of links; in each the row with the smallest doc_id (nulls last,
    then the text's hash) has ``keep``.  ``text_key`` is xxhash64 of the text, so that
    ``(doc_id, text_key)`` finds the row again; rows equal in both are all marked.

    Texts without words (null, empty, blank) form one group.  Sets are made again for
    the texts that have candidates, so that no others are stored.
    """
    spark = docs.sparkSession
    texts = ready_workers(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.col("text").cast("binary").alias("text"))
    prints = materialise(texts.mapInArrow(
        _prints_and_keys(shingle), "doc_id long, text_key long, print binary, keys array<long>, digest binary"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    distinct = materialise(prints.groupBy("digest").agg(F.min(rank).alias("best"), F.first("print").alias("print"),
                                                         F.first("keys").alias("keys"))
                           .withColumn("node", F.monotonically_increasing_id()))
    together = materialise(print_candidates(distinct.select("node", "print"), similarity))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(_met(distinct.repartition(n).select("node", F.explode("keys").alias("variant"))))
    candidates = together.select("node").unionAll(met.select("node")).distinct()
    wanted = distinct.join(candidates, "node").select("node", "digest", F.col("best.text_key").alias("text_key"))
    wanted = materialise(wanted)
    held = spark.sparkContext.broadcast(_bit_map(wanted))
    made = texts.select("text_key", "text").mapInArrow(
        _wanted_sets(shingle, held), "text_key long, digest binary, shingles binary")
    # A set that several rows have is met once.
    sets = materialise(made.join(wanted.select("node", "digest"), "digest").select("node", "shingles").dropDuplicates(["node"]))
    roots = set_links(met, sets, similarity, known=set_links(together, sets, similarity))
    labelled = distinct.join(roots, "node", "left").select("digest", "best", F.coalesce("root", "node").alias("group"))
    best = labelled.groupBy("group").agg(F.min("best").alias("winner"))
    labels = materialise(labelled.join(best, "group").select("digest", "group", "winner"))
    return prints.join(labels, "digest").select(
        "doc_id", "text_key", "group",
        (F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("text_key") == F.col("winner.text_key"))).alias("keep"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row per near-duplicate group; columns unchanged.

    The row with the smallest doc_id stays (nulls last); of rows equal in doc_id and
    text one stays.
    """
    groups = materialise(near_duplicate_groups(docs, shingle, similarity))
    kept = groups.where("keep").groupBy("doc_id", "text_key").count()
    chosen = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    out = docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(chosen["_kept_id"])
                    & (F.xxhash64("text") == chosen["_kept_key"]), "left_semi")
    # Only rows repeated in both id and text could still stand twice.
    if kept.where("count > 1").limit(1).count():
        key = "_text_key_of_near_duplicates"
        out = out.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
    return out
