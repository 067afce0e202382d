"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm import (decontam, embed_dedup, langid, licenses, merkle, mixing, quality, simhash, tokenbin, toxicity,
                          urlfilter, warc, whitening)

TOKENIZER = "word_bpe_49k.json"
# Documents of this remainder of crc32(doc_id) are held out from learning languages.
HELD_OUT, FOLDS = 2, 4
# Documents whose crc32(doc_id) this divides are held out from learning toxicity.
TOXICITY_FOLDS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, limit=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixing.mix_shares(_table(spark, sf_dir, "documents"), mixing.label_weights(_table(spark, sf_dir, "labels")))
    return shares.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    model = langid.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    return langid.identify(docs, model, ["doc_id", held_out.alias("held_out")])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_documents(tokenbin.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.write_pages(_table(spark, sf_dir, "pages")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(merkle.document_leaves(_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                       "folded_root", "verified")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TOXICITY_FOLDS == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % TOXICITY_FOLDS != 0)
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), labels, ["doc_id", held_out.alias("held_out")])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(cast(deviation AS string) AS long)"))


QUERIES = {run.__name__: run for run in (
    op1_simhash, op2_mixing, op3_quality, op4_language, op5_decontamination, op6_embeddings, op7_url_filter, op8_licenses,
    op9_token_ids, op10_warc, op11_merkle, op12_toxicity, op13_whitening)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_mixing": r"""
WITH quality AS (
  SELECT doc_id, avg(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5 END) AS weight
  FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / coalesce(q.weight, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight
  FROM keyed GROUP BY source),
places AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source IS NULL, encode(source)) AS place FROM sources),
-- Try every number of capped sources; the right one caps exactly those whose cap is below their share.
tries AS (
  SELECT a.place, sum(b.source_size)::BIGINT - 3 * coalesce(sum(b.source_size) FILTER (b.place < a.place), 0)::BIGINT AS left_size,
    sum(b.weight) FILTER (b.place >= a.place)::BIGINT AS left_weight
  FROM places a CROSS JOIN places b GROUP BY a.place),
level AS (
  SELECT left_size, left_weight FROM tries JOIN places USING (place)
  WHERE 3 * source_size * left_weight > weight * left_size ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN left_weight IS NULL OR 3 * source_size * left_weight <= weight * left_size THEN 3 * source_size::DOUBLE
         ELSE weight * left_size / left_weight END::DOUBLE AS target
  FROM places LEFT JOIN level ON true),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT k.doc_id, k.size, c.source_size, c.target, c.epochs, c.target - c.epochs * c.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM keyed k JOIN cut c ON k.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run""",
    "op5_decontamination": rf"""
WITH items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sized AS (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
known AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM known))),
met AS (SELECT p.r, p.i, p.n, k.item_id FROM places p JOIN known k ON p.words = k.words AND p.n = k.n),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS word FROM met) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY encode(item_id)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op6_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v WHERE vec_id IS NOT NULL UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(counts.n, 0)::BIGINT AS n_links, least.component_id,
  coalesce(v.vec_id = least.component_id, false) AS kept
FROM v LEFT JOIN least ON v.vec_id = least.a LEFT JOIN counts ON v.vec_id = counts.a""",
    "op7_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
  ('block', 'com', '/de/')),
urls AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT u.r, max_by(rules.host || rules.path, len(rules.host || rules.path)) AS rule,
    max_by(rules.verdict, len(rules.host || rules.path)) AS verdict
  FROM urls u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
  GROUP BY u.r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (r)""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN first USING (payload_digest)""",
    # crc32 is worked out bit by bit from the digits of the id.
    "op11_merkle": """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, d.*, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents d),
fields AS (
  SELECT r, doc_id, lang, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS struck, n_chars,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM docs),
leaves AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(length((n_chars + struck::INT)::VARCHAR) || ':' || (n_chars + struck::INT), '-') || tail) AS held
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, place, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2),
subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY level, place // 2),
steps AS (
  SELECT p.r, s.level AS level, xor(p.place >> s.level, 1) < p.place >> s.level AS before, coalesce(x.node, '') AS sibling
  FROM placed p JOIN (SELECT DISTINCT lang, level, n FROM nodes WHERE n > 1) s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN nodes x ON x.lang IS NOT DISTINCT FROM p.lang AND x.level = s.level AND x.place = xor(p.place >> s.level, 1)
  UNION ALL
  SELECT p.r, 1000 + s.level, xor(b.place >> s.level, 1) < b.place >> s.level, coalesce(x.node, '')
  FROM placed p JOIN subroots b ON p.lang IS NOT DISTINCT FROM b.lang
  CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) s
  LEFT JOIN tops x ON x.level = s.level AND x.place = xor(b.place >> s.level, 1)),
proofs AS (
  SELECT r, string_agg(sibling, '' ORDER BY level) AS siblings,
    list({'before': before, 'sibling': sibling} ORDER BY level) AS path FROM steps GROUP BY r),
folds AS (
  SELECT p.r, 1 AS step, p.held AS node, coalesce(len(path), 0) AS height FROM placed p LEFT JOIN proofs USING (r)
  UNION ALL
  SELECT f.r, step + 1, CASE WHEN path[step].before THEN sha256(path[step].sibling || node) ELSE sha256(node || path[step].sibling) END, height
  FROM folds f JOIN proofs USING (r) WHERE step <= height)
SELECT p.doc_id, p.leaf, b.subroot, t.node AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.node AS folded_root,
  f.node = t.node AS verified
FROM placed p JOIN subroots b ON p.lang IS NOT DISTINCT FROM b.lang JOIN tops t ON t.n = 1
  JOIN folds f ON f.r = p.r AND f.step > f.height LEFT JOIN proofs q ON q.r = p.r""",
}
