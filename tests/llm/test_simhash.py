import random

import numpy as np
import pytest
import xxhash

from colweave.llm import simhash
from colweave.llm.components import components

SCHEMA = "doc_id long, text string, fp string, node long, text_key long"


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(rows, limit=2):
    prints = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def texts(n=60):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "Delta", "épée", "x1", "the", "of", "and", "zeta"]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))) for i in range(n)]
    long = " ".join(rng.choices(vocabulary, k=4000))
    return out + [(100, long), (101, long + " omega"), (102, long.upper()), (103, None), (104, ""), (105, " \t\r\n"),
                  (7, "same id other text"), (7, "same id other text"), (None, "alpha beta"), (None, None), (106, "a\x1cb\x0bc")]


def test_components_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], SCHEMA)
    got = [tuple(r) for r in simhash.simhash_components(df).collect()]
    assert sorted(got, key=str) == slow_components(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []


def near_prints(rng, n):
    """Fingerprints in families: some within a bit or two of others."""
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randint(0, 6)):
            other = base
            for b in rng.sample(range(64), rng.randint(1, 3)):
                other ^= 1 << b
            out.add(other)
            base = rng.choice([base, other])
    return sorted(out)


def test_variant_links_find_every_pair_even_in_dense_blocks(spark):
    rng = random.Random(9)
    prints = near_prints(rng, 250)
    # A dense family: all within 3 low bits and 5 high bits.
    prints = sorted(set(prints) | {(a << 59) | b for a in range(12) for b in range(8)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = [(s, [p & 0xFFFFFFFF, p >> 32], p.to_bytes(8, "little")) for s, p in zip(signed, prints)]
    nodes = spark.createDataFrame(rows, "node long, segments array<long>, print binary")
    for block_rows in (2048, 5):
        roots = {r["node"]: r["root"] for r in components(simhash.variant_links(nodes, 32, 2, block_rows)).collect()}
        parent = {s: s for s in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, p in enumerate(prints):
            for j in range(i):
                if (p ^ prints[j]).bit_count() <= 2:
                    a, b = find(signed[i]), find(signed[j])
                    parent[max(a, b)] = min(a, b)
        assert {s: roots.get(s, s) for s in signed} == {s: find(s) for s in signed}


def test_bit_counts_of_many_rows():
    rng = np.random.default_rng(1)
    for n in (1, 254, 255, 256, 20_000):
        h = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
        want = [int(((h[:, k] >> np.uint64(b)) & np.uint64(1)).sum()) for k in range(2) for b in range(64)]
        assert simhash.bit_counts(h).tolist() == want


def test_near_copies_fall_and_clean_documents_stay(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    clean = [(i, " ".join(word() for _ in range(250))) for i in range(40)]
    near = []
    for i, text in clean[:20]:
        words = text.split()
        words[rng.randrange(250)] = word()
        words[rng.randrange(250)] = word()
        near.append((100 + i, " ".join(words)))
    exact = [(200 + i, text.upper() if i % 2 else text) for i, text in clean[20:30]]
    # A passage of 60 words that two otherwise different documents share is no near copy.
    shared = [(300 + k, " ".join([word() for _ in range(190)] + clean[39][1].split()[:60])) for k in range(3)]
    odd = [(None, "no id at all " + word()), (400, None), (401, ""), (402, clean[35][1]), (402, clean[35][1])]
    rows = clean + near + exact + shared + odd
    df = spark.createDataFrame([(d, t, "c", 5, 6) for d, t in rows], SCHEMA)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([*range(40), 300, 301, 302, None, 400], key=str)


def test_one_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(1, "one two three four five six")] * 4 + [(None, "seven eight nine ten")] * 3, "doc_id long, text string")
    assert sorted((r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()), key=str) == [1, None]


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def edited_pairs(rng, low=0.8, high=0.9, n=100):
    """Texts and their copies with text appended, a block replaced or the end cut off, at a shingle similarity in a range."""
    vocabulary = [f"w{i}" for i in range(4000)]
    chance = [1 / (i + 1) for i in range(4000)]
    draw = lambda k: rng.choices(vocabulary, chance, k=k)
    sets = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    out = []
    while len(out) < 3 * n:
        words = draw(300)
        part = rng.randint(20, 70)
        kind = len(out) % 3
        copy = words + draw(part) if kind == 0 else words[:100] + draw(part // 2) + words[100 + part // 2:] if kind == 1 else words[:-part]
        a, b = sets(words), sets(copy)
        if low <= len(a & b) / len(a | b) <= high:
            out.append((" ".join(words), " ".join(copy)))
    return out


def test_appended_replaced_and_cut_copies_are_candidates(spark):
    pairs = edited_pairs(random.Random(5))
    df = spark.createDataFrame([(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)], "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in simhash.near_duplicate_groups(df).collect()}
    found = np.array([group[2 * i] == group[2 * i + 1] for i in range(len(pairs))])
    assert found.all()
    keys = [[set(simhash.band_keys(x).tolist()) for x in simhash._shingle_sets(simhash.pa.array([t.encode() for t in p]), 5)] for p in pairs]
    assert all(a & b for a, b in keys)


def test_every_link_has_the_similarity(spark):
    """Scattered edits at similarities of 0.5 to 1: groups are the components of the pairs of 0.8 or more."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for family in range(60):
        base = [word() for _ in range(150)]
        rows.append(" ".join(base))
        for _ in range(3):
            words = list(base)
            for i in rng.sample(range(150), rng.randint(1, 14)):
                words[i] = word()
            rows.append(" ".join(words))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    near = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a & b}
    assert sum(0.6 <= x < 0.8 for x in near.values()) > 30
    root = list(range(len(rows)))
    for _ in rows:
        for (i, j), x in near.items():
            if x >= 0.8:
                root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    first = {}
    for r in sorted(simhash.near_duplicate_groups(df).collect()):
        assert root[r["doc_id"]] == first.setdefault(r["group"], r["doc_id"])
    assert len(first) == len(set(root))


@pytest.mark.parametrize("block_rows", [1000, 3, 1])
def test_links_of_sets_in_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(4):
        base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        for _ in range(8):
            own = base.copy()
            k = int(rng.integers(0, 8))
            own[rng.integers(0, 40, k)] = rng.integers(0, 1 << 63, k, dtype=np.uint64)
            sets.append(np.unique(own))
    keyed = spark.createDataFrame([(i, v, len(sets)) for i in range(len(sets)) for v in (1, 2)], "node long, variant long, count long")
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, shingles binary")
    found = {r["node"]: r["root"] for r in simhash.set_links(keyed, table, 0.8, block_rows).collect()}
    root = list(range(len(sets)))
    for _ in sets:
        for i in range(len(sets)):
            for j in range(i):
                if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    assert [found.get(i, i) for i in range(len(sets))] == root


def test_fingerprints_find_near_copies_before_the_bands(spark, monkeypatch):
    """Links of SimHash candidates are there before any band is asked; unrelated texts are no candidates."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for _ in range(60):
        words = [word() for _ in range(300)]
        rows += [words, words + [word() for _ in range(8)]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    asked, whole = [], simhash.set_links
    monkeypatch.setattr(simhash, "set_links", lambda *args, **named: asked.append(whole(*args, **named)) or asked[-1])
    group = {r["doc_id"]: r["group"] for r in simhash.near_duplicate_groups(df).collect()}
    assert all(group[2 * i] == group[2 * i + 1] for i in range(60)) and len(set(group.values())) == 60
    by_prints, by_all = ({r["node"]: r["root"] for r in found.collect()} for found in asked)
    assert len(set(by_all.values())) == 60 and len(by_prints) >= 118 and by_prints.items() <= by_all.items()


def test_candidates_by_fingerprints_of_edited_copies(spark):
    pairs = edited_pairs(random.Random(5))
    sets = list(simhash._shingle_sets(simhash.pa.array([t.encode() for pair in pairs for t in pair]), 5))
    prints = spark.createDataFrame([(i, simhash.set_print(x)) for i, x in enumerate(sets)], "node long, print binary")
    rows = simhash.print_candidates(prints, 0.8).collect()
    found = {r["node"]: r["variant"] for r in rows}
    # Of 300 pairs of 0.80-0.90 fingerprints alone bring 199; the bands bring the rest.
    assert sum(found.get(2 * i, -1) == found.get(2 * i + 1) for i in range(len(pairs))) >= 190
    assert all(r["count"] == sum(v == r["variant"] for v in found.values()) for r in rows)


def test_known_classes_go_on(spark):
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 50, 55, 500)]
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, shingles binary")
    keyed = spark.createDataFrame([(i, 1, 4) for i in range(4)], "node long, variant long, count long")
    known = spark.createDataFrame([(1, 0), (0, 0)], "node long, root long")
    for block_rows in (100, 1):
        found = {r["node"]: r["root"] for r in simhash.set_links(keyed, table, 0.8, block_rows, known).collect()}
        assert [found.get(i, i) for i in range(4)] == [0, 0, 0, 3]
