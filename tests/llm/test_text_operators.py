import random
import re
import zlib

import numpy as np
import pytest

from colweave.llm import decontam, langid, licenses, mixing, quality
from colweave.llm import words as W
from colweave.llm.queries import op2_mixing, op4_language

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, source, len(t or ""), 0.5, "clash") for d, t, lang, source in rows], DOCS)


# ---- mixing -------------------------------------------------------------------------------

def test_targets_by_rounds_of_resharing(spark):
    sizes = [("a", 10), ("b", 4000), ("c", 300), ("d", 0), ("é", 70), ("Z", 5), (None, 900)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(
        spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    target, capped = {}, set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in size if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / share for s in size}
        above = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    assert got == pytest.approx(target)
    assert sum(got.values()) == pytest.approx(total)


def mixed_rows():
    rows = [(i, "w " * (i % 13), "en", "abc"[i % 3]) for i in range(300)]
    rows += [(1000 + i, "word " * 5, None, None) for i in range(40)]
    rows += [(5, "w " * 6, "en", "a"), (5, "w " * 6, "en", "a"), (None, "x y z", "en", "b"), (2000, None, "en", "c"), (2001, "", "en", "only empty"),
             (2002, "long " * 20_000, "de", "long")]
    return rows


def test_mix_comes_near_its_targets(spark):
    df = frame(spark, mixed_rows())
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    weights = mixing.label_weights(labels)
    got = mixing.mix_shares(df, weights).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted(
        (str(d), len((t or "").split())) for d, t, _, _ in mixed_rows())
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        x = by.setdefault(r["source"], [0, 0, r["target"], 0, r["source_size"]])
        x[0] += r["copies"] * r["size"]
        x[1] = max(x[1], r["size"])
        x[3] += r["size"]
    for taken, largest, target, size, source_size in by.values():
        assert size == source_size
        assert abs(taken - target) <= largest / 2 + 1e-9
    again = mixing.mix_shares(df, weights).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mix(df, weights)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in got)


def test_slices_do_not_change_the_mix(spark):
    df = frame(spark, mixed_rows())
    rows = [sorted(map(str, mixing.mix_shares(df, slice_rows=n).collect())) for n in (1, 10 ** 9)]
    assert rows[0] == rows[1]


def test_mix_of_nothing(spark):
    empty = frame(spark, [])
    assert mixing.mix_shares(empty).collect() == []
    assert mixing.mix(empty).collect() == []


def test_heavier_documents_come_earlier(spark):
    keys = spark.range(4000).selectExpr("id", "IF(id % 2 = 0, 4.0D, 1.0D) AS w")
    from pyspark.sql import functions as F
    mean = {r["w"]: r["k"] for r in keys.withColumn("k", mixing.sampling_key(F.col("id"), F.col("w"), 7)).groupBy("w").agg(F.avg("k").alias("k")).collect()}
    assert mean[1.0] == pytest.approx(1.0, rel=0.1) and mean[4.0] == pytest.approx(0.25, rel=0.1)


# ---- language -----------------------------------------------------------------------------

def test_languages_held_out(spark):
    got = op4_language(spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(langs) and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.97
    assert not any(r["rejected"] for r in got)


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    rows = [(1, None, None, None), (2, "", None, None), (3, "123 !? 456", None, None), (4, "the that with of", None, None),
            (5, "Ждут ответа щедрые юноши", None, None), (None, "the that with of " * 30_000, None, None), (4, "the that with of", None, None)]
    got = langid.identify(frame(spark, rows), model).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["rejected"]))
        assert 0 <= r["score"] <= 1
    assert by[1] == by[2] == by[3] == [("und", True)]
    assert by[4] == [("en", False)] * 2 and by[None] == [("en", False)]
    assert by[5][0][0] in model.languages
    kept = langid.drop_rejected(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns
    assert {1, 2, 3}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert [r["doc_id"] for r in kept.collect()].count(4) == 2


def test_no_labels_no_language(spark):
    docs = frame(spark, [(1, "the that", None, None)])
    model = langid.learn(docs)
    assert model.languages == ["und"]
    assert [r["lang_pred"] for r in langid.identify(docs, model).collect()] == ["und"]
    assert langid.identify(frame(spark, []), model).collect() == []


def test_every_language_is_learned(spark):
    names = [f"l{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} text", lang) for i, lang in enumerate(names)] * 2, "doc_id long, text string, lang string")
    assert sorted({r["lang"] for r in langid.labelled_sample(docs).collect()}) == sorted(names)


def test_subwords_do_not_cross_documents():
    texts = [b"ab", b"", b"cd ef", b"x"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bucket, owner = langid.subwords(data, np.cumsum([0, *map(len, texts)]))
    for d, text in enumerate(texts):
        alone, _ = langid.subwords(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
        assert sorted(bucket[owner == d].tolist()) == sorted(alone.tolist())


# ---- quality ------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels.where("doc_id % 3 <> 0"))
    scores = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(r["quality"], scores[r["doc_id"]]) for r in labels.where("doc_id % 3 = 0").collect()]
    assert len(scores) == docs.count()
    assert np.mean([x["keep"] for q, x in held if q == 1]) >= 0.95
    assert np.mean([not x["keep"] for q, x in held if q == 0]) >= 0.5


def test_co_training_reaches_every_unlabelled_document(spark):
    """A source that two of 12,000 unlabelled documents have gets a weight from them."""
    rare = next(f"rare{i}" for i in range(99) if quality._name_bucket("source", f"rare{i}") != quality._name_bucket("source", "s"))
    text = ["good words here and there " * 3, "$$ ## %% zz qq xx " * 4]
    rows = [(i, text[i % 2], "en", "s") for i in range(12_200)] + [(20_000, text[1], "en", rare), (20_001, text[1], "en", rare)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.learn(frame(spark, rows), labels)
    place = len(model.meta.weights) - quality.HASHED_NAMES + quality._name_bucket("source", rare)
    assert model.meta.weights[place] < 0


def test_quality_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "some text here", None, None), (3, "some text here", None, None), (None, "other " * 30_000, "en", "s")]
    no_labels = spark.createDataFrame([(1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    model = quality.learn(frame(spark, rows), no_labels)
    assert model is None
    got = [(r["doc_id"], r["score"], r["keep"]) for r in quality.score(frame(spark, rows), model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0.0, False), (2, 0.0, False), (3, 0.5, True), (3, 0.5, True), (None, 0.5, True)], key=str)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    docs = frame(spark, [(i, ("good words here " if i % 2 else "$$ ## %% ") * 20, None, None) for i in range(40)] + rows)
    scored = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(scored) == 45 and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(frame(spark, []), model).collect() == []
    assert quality.learn(frame(spark, []), labels) is None


# ---- decontamination ----------------------------------------------------------------------

def slow_contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        if item is None or not w:
            continue
        k = min(size, len(w))
        for i in range(len(w) - k + 1):
            windows.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def test_items_of_a_shared_passage_are_not_gathered_per_place(spark):
    passage = " ".join(f"word{i}" for i in range(14))
    items = spark.createDataFrame([(i, f"item {i} {passage}") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{passage} and {passage}"), (2, "word1 word2"), (None, passage)], "doc_id long, text string")
    found = decontam.contamination(docs, items)
    got = {r["doc_id"]: (r["n_items"], list(r["items"]), r["n_hit"]) for r in found.collect()}
    every = sorted(str(i) for i in range(50))
    assert got == {1: (50, every, 28), 2: (0, [], 0), None: (50, every, 14)}
    # Ids are gathered once, per document: not per window, and no array of ids is an aggregate's input.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "window_items" not in plan and plan.count("collect_list(item_id") == 1


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["un", "deux", "trois", "É", "x9", "fin"]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, draw(int(rng.integers(0, 30)))) for i in range(25)] + [(30, "Two words"), (31, "single"), (32, None), (None, "trois fin"),
                                                                      (33, ""), (1, "Two, words"), (100, "TWO words")]
    docs = [(i, draw(int(rng.integers(0, 60)))) for i in range(60)]
    docs += [(60, "a " * 50 + items[3][1].upper() + " z" * 50), (61, "two-words, single; two"), (62, None), (63, ""), (7, docs[7][1]), (7, "other text"),
             (None, items[5][1]), (64, "filler " * 40_000 + (items[8][1] or "") + " end")]
    docs_df = frame(spark, [(d, t, "en", "s") for d, t in docs])
    items_df = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, words string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"])
           for r in decontam.contamination(docs_df, items_df).collect()]
    want = slow_contamination(docs, items)
    assert sorted(got, key=str) == want
    left = decontam.drop_contaminated(docs_df, items_df)
    assert left.columns == docs_df.columns
    assert left.count() == sum(not w[-1] for w in want)


def test_shared_spans_always_share_a_fingerprint():
    rng = random.Random(2)
    for length in (1, 3, 5, 7, 10):
        for _ in range(60):
            shared = [rng.getrandbits(3) for _ in range(length)]  # few words, so that hashes tie
            texts = [np.array([rng.getrandbits(3) for _ in range(rng.randint(0, 12))] + shared
                              + [rng.getrandbits(3) for _ in range(rng.randint(0, 12))], dtype=np.uint64) for _ in range(2)]
            kept = []
            for t in texts:
                at = next(i for i in range(len(t)) if t[i:i + length].tolist() == shared)
                prints, place = decontam._winnowed(W.mix(t), length)
                kept.append((prints[at], place[at] - at))
            assert kept[0] == kept[1]
    # A text keeps far fewer fingerprints than it has windows.
    prints, place = decontam._winnowed(W.mix(np.arange(20_000, dtype=np.uint64)), 10)
    assert len(set(place.tolist())) < 0.35 * len(prints)


def test_many_hits_in_one_document(spark):
    """Separate hits, in their thousands, are merged in time that grows with their number."""
    import time
    item = " ".join(f"w{i}" for i in range(10))
    items = spark.createDataFrame([(1, item), (2, "w3 w4 w5 w6 w7 w8 w9 x y z")], "item_id long, text string")
    took = {}
    for n in (5_000, 20_000, 5_000, 20_000):
        docs = spark.createDataFrame([(1, f"{item} gap " * n)], "doc_id long, text string")
        start = time.perf_counter()
        r = decontam.contamination(docs, items).first()
        took[n] = time.perf_counter() - start
        assert (r["n_words"], r["n_hit"], r["n_items"], len(r["spans"])) == (11 * n, 10 * n, 1, n)
        assert [tuple(x) for x in r["spans"][:2]] == [(0, 10), (11, 21)]
    assert took[20_000] < 2.5 * took[5_000] + 4


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "some words", None, None)])
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in decontam.contamination(docs, items).collect()] == [(2, 0, False)]
    assert decontam.contamination(frame(spark, []), items).collect() == []


# ---- licenses -----------------------------------------------------------------------------

def test_license_phrases_against_brute_force(spark):
    texts = ["CC BY cc-by, Cc by all rights\nreserved.", "cc cc by by general public license general public", None, "", "reserved",
             "ALL RIGHTS RESERVED " * 3, "x " * 30_000 + "all rights reserved", "Licensed under the Apache License, Version 2.0.",
             "licensed under really the apache license version 2 0", "Released under the MIT License", "licensed under the other license"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(1, texts[1], None, None), (None, texts[0], None, None)]
    got = licenses.scan(frame(spark, rows)).collect()
    want = []
    for d, text, _, _ in rows:
        w, places, labels = WORD.findall(lower(text)), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[7]["labels"] == "apache" and by[7]["score"] == 1.0
    assert by[8]["labels"] == "apache" and 0.7 <= by[8]["score"] < 1.0  # an inserted word moves the diagonal by one
    assert by[9]["labels"] == "mit" and by[10]["labels"] == "" and by[10]["score"] == 0.0
    assert by[2]["labels"] == "" and by[2]["n_words"] == 0
    assert licenses.scan(frame(spark, [])).collect() == []


def slow_spans(words, template, coverage, gap):
    """Merged diagonals of a template's word pairs, pair by pair."""
    pairs = list(zip(template, template[1:]))
    cells = {}
    for p in range(len(words) - 1):
        for t, pair in enumerate(pairs):
            if pair == (words[p], words[p + 1]):
                cells.setdefault(p - t, []).append((p, t))
    spans, run = [], None
    for diagonal in sorted(cells):
        if run is None or diagonal - run[0] > gap:
            run = [diagonal, set(), 10 ** 9, -1]
            spans.append(run)
        run[0] = diagonal
        run[1] |= {t for _, t in cells[diagonal]}
        run[2] = min([run[2], *(p for p, _ in cells[diagonal])])
        run[3] = max([run[3], *(p for p, _ in cells[diagonal])])
    return [(low, high + 2, len(seen) / len(pairs)) for _, seen, low, high in spans if len(seen) / len(pairs) >= coverage]


def test_license_diagonals_against_brute_force(spark):
    rng = random.Random(3)
    listed = {"one": ("a b c d e f g", "x y z x y"), "two": ("c d e a b c d", "q r")}
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice([t for ts in listed.values() for t in ts]).split()
            for _ in range(rng.randint(0, 3)):  # words left out, put in and replaced
                at = rng.randrange(len(t) + 1)
                t[at:at + rng.randint(0, 1)] = rng.choices("abcxyzqr", k=rng.randint(0, 2))
            w += t + rng.choices("mnop", k=rng.randint(0, 3))
        texts.append(" ".join(w))
    got = licenses.scan(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), {"a b": "ab"}, listed, 0.6, 1).collect()
    for r in got:
        words, spans = texts[r["doc_id"]].split(), []
        for label, ts in listed.items():
            for t in ts:
                spans += [(label, *s) for s in slow_spans(words, t.split(), 0.6, 1)]
        base = [("ab", i, i + 2, 1.0) for i in range(len(words) - 1) if words[i:i + 2] == ["a", "b"]]
        found = spans + base
        assert sorted((s["label"], s["start"], s["end"]) for s in r["spans"]) == sorted(s[:3] for s in found)
        assert r["labels"] == ",".join(sorted({s[0] for s in found}))
        assert r["score"] == pytest.approx(max((s[3] for s in found), default=0.0))


def test_license_scan_of_letters_beyond_ascii(spark):
    got = licenses.scan(frame(spark, [(1, "CC BY", None, None), (2, "\u212a \u0130 cc by", None, None)])).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"]) for r in got} == {1: (2, 1), 2: (4, 1)}


def test_license_scan_time_grows_with_words(spark):
    import time
    texts = {n: " ".join(f"w{i % 977}" for i in range(n)) + " all rights reserved" for n in (80_000, 320_000)}
    took = {}
    for n in (80_000, 320_000, 80_000, 320_000):
        start = time.perf_counter()
        assert licenses.scan(frame(spark, [(1, texts[n], None, None)])).first()["first_word"] == n
        took[n] = time.perf_counter() - start
    assert took[320_000] < 2.5 * took[80_000] + 3


def test_license_scan_is_native(spark):
    plan = licenses.scan(frame(spark, [(1, "cc by", None, None)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_query_matches_documents(spark):
    got = op2_mixing(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_views_against_byte_loops():
    """Trigrams, layout and mean weights of many short documents."""
    rng = np.random.default_rng(6)
    weights = rng.normal(size=quality.BUCKETS)
    for _ in range(300):
        size = rng.integers(0, 6, rng.integers(1, 8))
        offsets = np.r_[0, np.cumsum(size)]
        data = rng.integers(9, 256, offsets[-1]).astype(np.uint8)
        bucket, owner = quality.text_buckets(data, offsets)
        assert owner.tolist() == [d for d, n in enumerate(size) for _ in range(max(0, n - 2))]
        texts = [data[a:b] for a, b in zip(offsets, offsets[1:])]
        alone = [quality.text_buckets(t, np.array([0, len(t)]))[0] for t in texts]
        assert bucket.tolist() == np.concatenate(alone).tolist()
        means = [weights[b].mean() if len(b) else 0.0 for b in alone]
        assert np.allclose(quality._text_mean(weights, bucket, owner, len(size)), means)
        shape = quality.layout(data, offsets)
        digits = [sum(0x30 <= x < 0x3A for x in t.tolist()) / max(1, len(t)) for t in texts]
        assert np.allclose(shape[:, 1 + list(quality._CLASSES).index("digit")], digits)
