import re
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from colweave.llm import simhash, tokenbin
from colweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage returns, written and read again, starting from all documents and some odd ones."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123 456", "en", None, 7), (None, "the that with of and in re er", None, "src1", 29)], base.schema)
    docs = base.unionByName(odd)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(tables):
    for stage in tables[1:-1]:
        assert stage.columns == tables[0].columns


def test_language_stage_drops_what_has_no_letters(tables):
    before, after = (sorted(str(r["doc_id"]) for r in t.collect()) for t in tables[:2])
    assert sorted(set(before) - set(after)) == ["9001", "9002"]


def test_dedup_stage_against_brute_force(tables):
    before, after = ({r["doc_id"]: r["text"] for r in t.collect()} for t in tables[1:3])
    sets = {d: shingles(t) for d, t in before.items()}
    ids = sorted(before, key=lambda d: (d is None, d))
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i, a in enumerate(ids):
        if a not in after:
            # What goes resembles something.
            assert max(similar(a, b) for b in ids if b != a) >= 0.6
        else:
            assert all(similar(a, b) < 0.8 for b in ids[:i] if b in after)
    assert len(after) < len(before)


def test_decontamination_stage(spark, tables):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(low(r["text"]))
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    before, after = ({r["doc_id"]: word.findall(low(r["text"])) for r in t.collect()} for t in tables[2:4])
    bad = {d for d, w in before.items() if any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))}
    assert bad and set(after) == set(before) - bad


def test_mixing_stage(tables):
    size = {}
    for r in tables[3].collect():
        size.setdefault(r["source"], []).append(len(SPACED.findall(r["text"])))
    total = sum(map(sum, size.values()))
    taken = sum(len(SPACED.findall(r["text"])) for r in tables[4].collect())
    assert abs(taken - total) <= sum(max(x) for x in size.values())
    assert {r["doc_id"] for r in tables[4].collect()} <= {r["doc_id"] for r in tables[3].collect()}


def test_token_stage(tables):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in tables[4].collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    got = sorted((tuple(r) for r in tables[5].collect()), key=lambda r: r[1])
    assert sorted(want, key=str) == sorted(((d, n, c) for d, _, n, c in got), key=str)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()


def test_run_is_the_stages(spark, tables):
    assert corpus_pipeline.run(spark, SF).columns == tables[-1].columns
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_near_copies_at_the_threshold(spark):
    """Recall over all pairs of 0.8 or more, and what is merged below, on the larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    group = {r["doc_id"]: r["group"] for r in simhash.near_duplicate_groups(docs).collect()}
    pairs = [(a, b, len(rows[a] & rows[b]) / len(rows[a] | rows[b])) for a in rows for b in rows if a < b and rows[a] & rows[b]]
    near = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert near and np.mean([group[a] == group[b] for a, b in near]) >= 0.99
    assert not [1 for a, b, j in pairs if j < 0.4 and group[a] == group[b]]


def test_workers_get_small_batches(spark):
    """10,000 long rows were one batch, held by the executor and by its workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(400).selectExpr("id", "repeat('word next ', IF(id = 7, 400000, 4000)) AS text").repartition(1)

    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    try:
        for stage in (corpus_pipeline.language_id, corpus_pipeline.decontamination):
            spark.conf.set(key, before)
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            largest, rows = docs.mapInArrow(sizes, "n long").selectExpr("max(n)", "sum(n)").first()
            assert largest <= 100 and rows == 400
    finally:
        spark.conf.set(key, before)


def test_workers_forget_words_and_encode_few_at_a_time(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta number{i}") for i in range(50)], "doc_id long, text string").repartition(1)
    remembered = 12_345  # an encoder of its own in each worker
    tokenbin.write_tokens(docs, tokenizer_path(), str(tmp_path), shards=2, remembered=remembered, keep=False).collect()

    def held(batches):
        import pyarrow as pa
        for _ in batches:
            encoder = tokenbin._encoder(tokenizer_path(), True, remembered)
            yield pa.RecordBatch.from_pydict({"n": [len(encoder.known) + len(encoder.older)]})

    assert spark.range(16).repartition(8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0

    class Counted:
        def __init__(self, inner):
            self.inner, self.largest, self.model = inner, 0, inner.model

        def encode_batch_fast(self, texts, **options):
            self.largest = max(self.largest, sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **options)

    encoder = tokenbin.PieceEncoder(tokenizer_path())
    text = " ".join(f"w{i}x-{i}" for i in range(30_000)).encode()
    want = encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    encoder.tokenizer = Counted(encoder.tokenizer)
    ids, _ = encoder.encode(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), 2)
    assert ids.tolist() == [*want, 2]
    assert encoder.tokenizer.largest <= 2 * tokenbin.ENCODED_CHARS < len(text)
