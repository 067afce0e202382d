import hashlib
import random
import zlib

import numpy as np
import pytest

from colweave.llm import embed_dedup, store, tokenbin, urlfilter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ---- embeddings ---------------------------------------------------------------------------

def slow_links(rows, threshold=0.95):
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in rows if v), default=0)
    unit = {i: np.pad(np.array(rows[i][1], dtype=np.float32).astype(float), (0, width - len(rows[i][1]))) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in good:
        for j in good:
            if i < j and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in good:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if i in unit else d
        out.append((d, links[i], c, d is not None and d == c))
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    for k in range(60):
        base = np.array(rows[k % 20][1])
        rows.append((200 + k, (base * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0.05, 0.3])).tolist()))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 8), (304, [float("nan")] * 8), (305, [1.0, None] * 4),
             (306, [float("inf")] + [0.0] * 7), (307, []), (None, rows[1][1]), (5, rows[9][1]), (308, [1e-30] * 8), (309, [1e30] * 8), (310, [1.0, -0.0]), (311, [1.0])]
    return rows


@pytest.mark.parametrize("block_rows", [8192, 7])
def test_embedding_links_against_brute_force(spark, block_rows):
    rows = vectors()
    df = spark.createDataFrame([(d, v, "clash", 3) for d, v in rows], "vec_id long, embedding array<float>, node string, links long")
    got = [tuple(r) for r in embed_dedup.embedding_components(df, block_rows=block_rows).collect()]
    assert sorted(got, key=str) == slow_links(rows)


def test_cells_miss_no_link():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(400, 6))
    rows = np.concatenate([rows, rows + rng.normal(size=rows.shape) * 0.12])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    own, present = embed_dedup.visits(rows, embed_dedup.fit_cells(rows, 12), 0.95)
    i, j = np.nonzero(rows @ rows.T >= 0.95)
    assert len(i) > len(rows) and present[j, own[i]].all()


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert embed_dedup.embedding_components(spark.createDataFrame([], schema)).collect() == []
    only_bad = spark.createDataFrame([(1, None), (None, [0.0])], schema)
    assert sorted((tuple(r) for r in embed_dedup.embedding_components(only_bad).collect()), key=str) == sorted(
        [(1, 0, 1, True), (None, 0, None, False)], key=str)


# ---- URLs ---------------------------------------------------------------------------------

def slow_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls_against_brute_force(spark):
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "notexample.org", "x.com", "com", "org", "a..org", "example.org:80", "é.org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/19?x=/es/", "/fr/a#b", "/de/", "/DE/", "?q=/es/", "#/es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "ftp://a://b/", "x://y\n/es/\nz", "http://" + "a." * 3000 + "org/" + "b" * 5000]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "clash"), (None, urls[5], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = list(urlfilter.RULES) + [("block", "a.example.org", "/"), ("allow", None, "/"), ("block", "", "/")]
    got = [tuple(r) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()]
    clean = [r for r in rules if r[1]]
    assert sorted(got, key=str) == sorted(((i, *slow_verdict(u, clean)) for i, u, _ in rows), key=str)


def test_prefix_join_confirms_whole_digests(spark):
    """With a prefix of one digit most expressions meet rules that are not theirs; only whole digests count."""
    urls = [f"http://{h}{p}" for h in ("a.org", "b.org", "a.b.org", "c.com") for p in ("/", "/x/", "/y/", "/x/y/", "/zz")]
    rules = [("block" if i % 3 else "allow", h, p) for i, (h, p) in enumerate(
        [("a.org", "/x/"), ("b.org", "/y"), ("org", "/zz"), ("com", "/x/"), ("a.b.org", "/"), ("c.com", "/x/y/"), ("d.net", "/")])]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = urlfilter.judge(pages, urlfilter.rule_table(spark, rules), prefix_digits=1)
    assert sorted(map(tuple, judged.collect())) == sorted((i, *slow_verdict(u, rules)) for i, u in enumerate(urls))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and joins[0].count("=") == 1 and "prefix" in joins[0]


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = urlfilter.rule_table(spark, [])
    assert [tuple(r) for r in urlfilter.judge(pages, rules, "block").collect()] == [(1, "a.org", "/", None, "block")]
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).collect() == []


# ---- token files --------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = tokenbin.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert tokenbin.unpack(data, bits, n).tolist() == ids.tolist()


def test_id_bits():
    assert [tokenbin.id_bits(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def encoded(encoder, texts):
    """The ids of each text, as lists."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ids, sizes = encoder.encode(data, np.cumsum([0, *map(len, raw)]), 2)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_pieces_encode_as_whole_texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "ß", "İ", "K", "1", "٣", " ", "\n", "\x1c", "\x85", "\xa0", "'s", "'T", "'", ".", ",", "|)", "<|endoftext|>",
             "<|ENDOFTEXT|>", "<|", "\u0301", "\u0338", "日本", "😀", "×", "ﬁ", "\x00", "</w>", "don't.", "Σς"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    encoder = tokenbin.PieceEncoder(TOKENIZER)
    got = encoded(encoder, texts)
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert encoded(tokenbin.PieceEncoder(TOKENIZER, pieces=False), texts[:50]) == got[:50]
    assert encoded(encoder, ["", " ", "a"])[:2] == [[2], [2]]


def test_capitals_that_compose_only_when_small():
    """NFC comes before lower-casing: a capital and its mark stay two characters where only the small letter composes."""
    import unicodedata
    marks = [chr(c) for c in range(0x300, 0x345)]
    apart = [a + m for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks
             if len(unicodedata.normalize("NFC", a + m)) > len(unicodedata.normalize("NFC", a.lower() + m))]
    assert {"J\u030c", "T\u0308", "W\u030a", "Y\u030a", "H\u0331"} <= set(apart)
    texts = [x for a in apart for x in (a, f"{a}an, ", f"x{a}", f"({a}URA) OTHER \u00c9T\u00c9.", f"{a}\u0301 {a.lower()}")]
    encoder = tokenbin.PieceEncoder(TOKENIZER)
    got = encoded(encoder, texts)
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("block_ids", [1 << 16, 3])
def test_token_files_against_the_tokenizer(spark, block_ids):
    rows = [(i, f"Text number {i}, été! " * (i % 5)) for i in range(60, 0, -1)]
    rows += [(100, None), (101, ""), (7, "same id"), (7, "same id"), (None, "no id"), (102, "long text " * 20_000)]
    df = spark.createDataFrame([(d, t, 9, "clash") for d, t in rows], "doc_id long, text string, start long, uri string")
    manifest = tokenbin.write_tokens(df, TOKENIZER, shards=5, block_ids=block_ids)
    got = sorted((tuple(r) for r in tokenbin.read_documents(manifest).collect()), key=lambda r: r[1])
    tokenizer = tokenbin.PieceEncoder(TOKENIZER).tokenizer
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    assert sorted(((d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in ids), key=str) == sorted(
        ((d, n, crc) for d, _, n, crc in got), key=str)
    assert [d for d, *_ in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [s for _, s, _, _ in got] == np.cumsum([0, *[n for _, _, n, _ in got]])[:-1].tolist()
    start, count = got[20][1] - 2, got[20][2] + got[21][2] + 2
    found = tokenbin.read_range(manifest, start, count)
    by_id = dict(ids)
    assert found[2:].tolist() == by_id[got[20][0]] + by_id[got[21][0]]


def test_no_documents_no_tokens(spark):
    manifest = tokenbin.write_tokens(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER)
    assert manifest.collect() == [] and tokenbin.read_documents(manifest).collect() == []


# ---- WARC ---------------------------------------------------------------------------------

def slow_records(rows):
    body = [((h or "").encode()) for _, _, h in rows]
    first = {}
    for (page, _, _), b in zip(rows, body):
        if len(b) >= 100 and page is not None:
            first[b] = min(page, first.get(b, page))
    out = []
    for (page, _, _), b in zip(rows, body):
        refers = first.get(b)
        revisit = refers is not None and page != refers
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    same = "<p>é</p>\r\n\r\n" * 20
    rows = [(9, "http://a/", same), (4, "http://b/\r\nX: y", same), (5, None, same), (4, "http://b/", same), (None, "u", same), (6, "http://c/", None),
            (7, "http://c/", ""), (8, "http://c/", "short"), (10, "http://c/", "short"), (11, "http://d/", "x" * 99), (12, "http://d/", "x" * 99),
            (13, "http://d/", "x" * 100), (14, "http://d/", "x" * 100), (15, "http://é/ü?", "".join(map(chr, range(1, 3000))) * 300),
            (16, "http://e/", "".join(map(chr, range(1, 3000))) * 300), (None, "n", "only without id " * 20)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_pages(pages)
    assert sorted((tuple(r) for r in warc.read_pages(manifest).collect()), key=str) == slow_records(rows)
    kinds = []
    for row in manifest.collect():
        with store.open_input(row["uri"]) as source:
            kinds += [warc.parse(m)[0]["warc-type"] for m in warc.members(source)]
    assert kinds.count("continuation") > 10 and "revisit" in kinds


def test_lost_and_short_segments_are_found():
    block = warc.HTTP_HEAD + warc.chunked(b"abc" * 20_000)
    digest = hashlib.sha256(b"abc" * 20_000).hexdigest()
    parts = [block[i:i + 9000] for i in range(0, len(block), 9000)]
    rows = [{"origin": "o", "page_id": 1, "payload_digest": f"sha256:{digest}", "segment": k, "total": len(block) if k == len(parts) else None, "block": p}
            for k, p in enumerate(parts, 1)]
    assert warc.assembled(rows)["payload_bytes"] == 60_000
    for bad in (rows[:-1], rows[:2] + rows[3:], [*rows[:-1], {**rows[-1], "total": 5}], [{**rows[0], "payload_digest": "sha256:0"}, *rows[1:]]):
        with pytest.raises(warc.ArchiveError):
            warc.assembled(bad)


def test_chunked_framing():
    for body in (b"", b"a", b"\r\n0\r\n\r\n" * 5000):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc"):
        with pytest.raises(warc.ArchiveError):
            warc.dechunked(bad)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_pages(warc.write_pages(pages)).collect() == []
