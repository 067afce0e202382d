import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from colweave.llm import toxicity
from colweave.llm import words as W
from colweave.llm.queries import op12_toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, run string, chunk long"
SF = "/root/testdata/sf0.001"
ORDINARY = [a + b for a in ("ta", "me", "so", "lin", "gar", "pe") for b in ("ra", "no", "ti", "len", "mos")]
ABUSE = ["wretch", "wretched", "vermin"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    out, word = [], b""
    for b in lower(text).encode() + b" ":
        if b >= 0x80 or chr(b).isalnum():
            word += bytes([b])
        elif word:
            out.append(word)
            word = b""
    return out


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(ORDINARY) for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(ABUSE))
        docs.append((i, " ".join(text).capitalize() + ".", "en", "s", 0.5, "clash", 1))
        if i % 5:
            labels.append((i, int(bad), 9))
    return docs, labels


def score(spark, docs, labels, **more):
    made = toxicity.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, score int"), **more)
    return made.collect()


def brute_weights(texts, label):
    """Log ratio of every byte run, by the formulas, from plain dictionaries."""
    def runs(word):
        word = bytes(4) + word + b" "
        return [word[i - 4:i + 1] for i in range(4, len(word))]

    kinds, counts = set(), (Counter(), Counter())
    for text, y in zip(texts, label):
        for word in words_of(text):
            for r in runs(word):
                kinds.add(r)
                if y is not None:
                    counts[y][r] += 1

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return one / (one + 2 * two) if one else 0.5

    def smooth(count, below):
        d, total, types = discount(count.values()), defaultdict(int), defaultdict(int)
        for r, c in count.items():
            total[r[:-1]] += c
            types[r[:-1]] += c > 0
        return lambda r: ((max(count[r] - d, 0) + d * types[r[:-1]] * below(r[1:])) / total[r[:-1]]) if total[r[:-1]] else below(r[1:])

    levels, above = {}, kinds
    for order in (4, 3, 2, 1):
        levels[order] = Counter(r[1:] for r in above)
        above = set(levels[order])
    below = lambda r: 1 / 256
    for order in (1, 2, 3, 4):
        below = smooth(levels[order], below)
    toxic, ordinary = smooth(counts[1], below), smooth(counts[0], below)
    return {r: (math.log(toxic(r)) - math.log(ordinary(r)) if r[2] else 0.0) for r in kinds}, runs


def test_evidence_against_brute_force(spark):
    docs, labels = corpus(n=60)
    docs += [(900, None, None, None, 0.1, "x", 2), (901, "", "en", "s", 0.1, "x", 2), (902, "!!! ...", "en", "s", 0.1, "x", 2),
             (903, "Übermäßig wretched Ñandú 12", "de", "s", 0.1, "x", 2), (5, docs[5][1], "en", "s", 0.1, "x", 2)]
    sheets = toxicity.count_words(spark.createDataFrame(docs, DOCS), ["doc_id"])
    label = dict(x[:2] for x in labels)
    taught = sheets.rows.where("place IS NOT NULL").join(
        spark.createDataFrame(labels, "doc_id long, toxic int, score int").select("doc_id", "toxic"), "doc_id").select("chunk", "place", "toxic")
    zero = sheets.rows.where("run >= 0").selectExpr("run", "0L AS toxic", "0L AS ordinary")
    counts = zero.unionAll(toxicity._class_counts(sheets, taught)).groupBy("run").sum("toxic", "ordinary").toDF("run", "toxic", "ordinary")
    weights = toxicity.run_weights(counts)
    want, runs = brute_weights([d[1] for d in docs], [label.get(d[0]) for d in docs])
    have = {int(r["run"]).to_bytes(5, "big"): r["weight"] for r in weights.collect()}
    assert have.keys() == want.keys()
    assert all(have[r] == pytest.approx(want[r], abs=1e-9) for r in want)
    got = sorted((r["doc_id"], r["_n_words"], round(r["_evidence"], 8)) for r in toxicity._evidence(sheets, weights).collect())
    assert got == sorted((d[0], len(words_of(d[1])), round(sum(want[r] for w in words_of(d[1]) for r in runs(w)) / (len(words_of(d[1])) + 30), 8))
                         for d in docs)


def test_finds_what_labels_mark(spark):
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in score(spark, docs, labels)}
    held = [i for i in range(240) if i % 5 == 0]
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    # Only the text is looked at: other columns do not move a score.
    moved = {r["doc_id"]: r["score"] for r in score(spark, [(*d[:2], "xx", "zz", *d[4:]) for d in docs], labels)}
    assert all(moved[i] == pytest.approx(got[i]["score"], abs=1e-12) for i in got)


def test_edges(spark):
    docs, labels = corpus(n=80)
    docs += [(None, "wretched vermin", None, None, 0.0, None, None), (800, None, "en", "s", 0.0, "x", 1), (801, "", "en", "s", 0.0, "x", 1),
             (802, "tara " * 60_000 + "wretched", "en", "s", 0.0, "x", 1), (802, "tara " * 60_000 + "wretched", "en", "s", 0.0, "x", 1)]
    labels += [(1, 0, 1), (1, 1, 1), (None, 1, 1), (2, None, 1), (3, 7, 1)]
    got = score(spark, docs, labels, keep=["doc_id", "lang", "score"][:2])
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert by[800]["evidence"] == by[801]["evidence"] == 0.0 and by[800]["score"] == by[801]["score"]
    assert by[None]["evidence"] > 0 and by[802]["n_words"] == 60_001
    assert score(spark, [], labels) == []
    assert {r["score"] for r in score(spark, docs[:9], [])} == {0.0}
    one_class = {r["score"] for r in score(spark, docs[:9], [(i, 1, 1) for i in range(9)])}
    assert len(one_class) == 1 and one_class.pop() > 0.5


def test_chunks_do_not_matter(spark, monkeypatch):
    docs, labels = corpus(n=100)
    whole = {r["doc_id"]: r["evidence"] for r in score(spark, docs, labels)}
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 900)
    parts = {r["doc_id"]: r["evidence"] for r in score(spark, docs, labels)}
    assert parts == pytest.approx(whole, abs=1e-9)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BYTES", 50)
    text = ("alpha beta, gamma; " * 30 + "x" * 400 + " omega").encode()
    data, offsets = np.frombuffer(text + b"tail end", dtype=np.uint8), np.array([0, len(text), len(text) + 8])
    found = []
    for part, edges, row in toxicity.segments(data, offsets):
        for k in range(len(edges) - 1):
            found += [(row + k, w) for w in words_of(part[edges[k]:edges[k + 1]].tobytes().decode())]
    assert Counter(found) == Counter([(0, w) for w in words_of(text.decode())] + [(1, b"tail"), (1, b"end")])


def test_query(spark):
    got = op12_toxicity(spark, SF)
    assert got.columns[:2] == ["doc_id", "held_out"] and got.count() == 200
