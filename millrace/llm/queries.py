"""Registered queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe_count, exact_dedup, license_scan, line_dedup, merkle, metric_search, mixing, ngram_join, packing, passages, phrases, toxicity, url_filter
from millrace.plans.registry import Registry, table

R = Registry()


@R.query(
    "op8_exact_dedup",
    """
    WITH t AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
    """,
)
def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf, "documents"))


@R.query("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; the driver alone reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@R.query("op4_token_count")
def op4_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf, "documents"), vocabulary())


@R.query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf, "documents"))


@R.query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


# Weights and levels as in millrace.llm.mixing; water filling by the share of weights not yet filled up.
MIX_SQL = """
WITH base AS (
  SELECT doc_id,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 'web'
         ELSE ['web', 'books', 'code', 'forum'][(CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT) % 4) + 1] END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
w(path, weight) AS (VALUES ('web', 4), ('books', 3), ('code', 2), ('forum', 1), ('web/en', 3), ('books/en', 3), ('code/en', 3), ('forum/en', 3)),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS capacity FROM base GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) / 2) AS BIGINT) AS budget FROM leaves),
d0 AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, coalesce(any_value(weight), 1) AS weight FROM leaves LEFT JOIN w ON path = domain GROUP BY domain),
d1 AS (SELECT *, budget - coalesce(sum(capacity) OVER p, 0) AS b_left, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS w_left FROM d0, total
  WINDOW p AS (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, capacity * w_left <= weight * b_left AS filled FROM d1),
d AS (SELECT domain, CAST(CASE WHEN filled THEN capacity ELSE least(capacity,
    (weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER (), 0))) // (sum(weight) FILTER (NOT filled) OVER ())) END AS BIGINT) AS budget FROM d2),
l0 AS (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, coalesce(any_value(weight), 1) AS weight FROM leaves LEFT JOIN w ON path = domain || '/' || lang GROUP BY domain, lang),
l1 AS (SELECT l0.*, budget, budget - coalesce(sum(capacity) OVER p, 0) AS b_left, sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER p, 0) AS w_left FROM l0 JOIN d USING (domain)
  WINDOW p AS (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, capacity * w_left <= weight * b_left AS filled FROM l1),
l AS (SELECT domain, lang, CAST(CASE WHEN filled THEN capacity ELSE least(capacity,
    (weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER p, 0))) // (sum(weight) FILTER (NOT filled) OVER p)) END AS BIGINT) AS budget FROM l2 WINDOW p AS (PARTITION BY domain)),
s1 AS (SELECT leaves.*, budget, budget - coalesce(sum(capacity) OVER p, 0) AS b_left, count(*) OVER (PARTITION BY domain, lang) - (row_number() OVER q - 1) AS w_left FROM leaves JOIN l USING (domain, lang)
  WINDOW p AS (PARTITION BY domain, lang ORDER BY capacity, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         q AS (PARTITION BY domain, lang ORDER BY capacity, source)),
s2 AS (SELECT *, capacity * w_left <= b_left AS filled FROM s1),
s AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN filled THEN capacity ELSE least(capacity,
    (budget - coalesce(sum(capacity) FILTER (filled) OVER p, 0)) // (count(*) FILTER (NOT filled) OVER p)) END AS BIGINT) AS budget FROM s2 WINDOW p AS (PARTITION BY domain, lang)),
plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM s),
ordered AS (SELECT base.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || epochs || ':' || doc_id), n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM base JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS INT) AS epoch FROM ordered WHERE rest > 0 AND reached <= rest
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(epochs)) AS INT) FROM ordered WHERE epochs > 0
"""


@R.query("op1_mixture", MIX_SQL)
def op1_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def _cut_sql() -> str:
    """The same plan; each leaf's last document is cut at the tokens that are left."""
    head, _, tail = MIX_SQL.rpartition("SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS INT) AS epoch FROM ordered WHERE rest > 0 AND reached <= rest")
    prefix = """SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS INT) AS epoch, CAST(least(n_tokens, rest - reached + n_tokens) AS BIGINT) AS taken
FROM ordered WHERE rest > 0 AND (reached <= rest OR reached - n_tokens < rest)"""
    return head + prefix + tail.replace("CAST(unnest(range(epochs)) AS INT)", "CAST(unnest(range(epochs)) AS INT), n_tokens")


@R.query("op1_mixture_cut", _cut_sql())
def op1_mixture_cut(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), cut=True)


@R.query("op2_packing")
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@R.query("op10_ngram_join")
def op10_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf, "documents"))


@R.query("op3_top_products")
def op3_top_products(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return metric_search.top_inner_products(vectors, vectors.where("vec_id % 20 = 0"))


@R.query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = line_dedup.remove_repeated_lines(docs, words=1)  # every line with a word takes part
    return done.select("doc_id", "n_lines", "removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


# The CRC-32 bit by bit, as DuckDB has no function for it; the tree level by level, then every leaf's climb.
MERKLE_SQL = """
WITH RECURSIVE
coded AS (SELECT doc_id, coalesce('=' || source, '') AS s, text,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) AS crc
  FROM documents),
leaves AS (SELECT doc_id, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS other,
    row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM coded)),
low AS (SELECT s, 0 AS lvl, pos, n, leaf AS hash FROM leaves
  UNION ALL SELECT s, lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY s, lvl, pos // 3),
tops AS (SELECT s, hash, row_number() OVER (ORDER BY s) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, pos, n, hash FROM tops
  UNION ALL SELECT lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 3),
runs AS (SELECT s, lvl, pos // 3 AS run, list(hash ORDER BY pos) AS h FROM low WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT lvl, pos // 3 AS run, list(hash ORDER BY pos) AS h FROM high WHERE n > 1 GROUP BY ALL),
climb AS (SELECT doc_id, s, leaf, 0 AS lvl, pos, n, other AS folded, '' AS met FROM leaves
  UNION ALL SELECT doc_id, s, leaf, lvl + 1, pos // 3, (n + 2) // 3,
    sha256(concat(array_to_string(h[1:pos % 3], ''), folded, array_to_string(h[pos % 3 + 2:], ''))),
    concat(met, array_to_string(h[1:pos % 3], ''), array_to_string(h[pos % 3 + 2:], ''))
  FROM (SELECT * FROM climb WHERE n > 1) JOIN (SELECT s AS rs, lvl AS rl, run, h FROM runs) ON rs = s AND rl = lvl AND run = pos // 3),
high_climb AS (SELECT doc_id, s, leaf, 0 AS lvl, tops.pos, tops.n, folded, met FROM climb JOIN tops USING (s) WHERE climb.n = 1
  UNION ALL SELECT doc_id, s, leaf, lvl + 1, pos // 3, (n + 2) // 3,
    sha256(concat(array_to_string(h[1:pos % 3], ''), folded, array_to_string(h[pos % 3 + 2:], ''))),
    concat(met, array_to_string(h[1:pos % 3], ''), array_to_string(h[pos % 3 + 2:], ''))
  FROM (SELECT * FROM high_climb WHERE n > 1) JOIN (SELECT lvl AS rl, run, h FROM high_runs) ON rl = lvl AND run = pos // 3)
SELECT doc_id, leaf, tops.hash AS subroot, peak.hash AS root, sha256(met) AS proof_sha256, folded AS folded_root, folded = peak.hash AS verified
FROM high_climb JOIN tops USING (s), (SELECT hash FROM high WHERE n = 1) AS peak WHERE high_climb.n = 1
"""


@R.query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    done = merkle.manifest(table(spark, sf, "documents"))
    proof = F.sha2(F.col("siblings").cast("binary"), 256)
    return done.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


PASSAGES_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 34], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM w)),
again AS (SELECT doc_id, pos FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM again),
lists AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ')
    ELSE array_to_string(list_where(words, list_transform(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i))), ' ') END) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""


@R.query("op12_passage_dedup", PASSAGES_SQL)
def op12_passage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = passages.without_repeats(table(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


PHRASES_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM pieces),
f AS (SELECT lang, k, array_to_string(words[pos:pos + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE pos + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
long AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
covers AS (SELECT lang, array_to_string(p[i:i + j - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, p, a, k, unnest(range(2, k)) AS j FROM long), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i + j - 1 <= k GROUP BY ALL),
kept AS (SELECT long.* FROM long LEFT JOIN covers USING (lang, phrase) WHERE covers.a IS NULL OR covers.a < long.a),
cuts AS (SELECT lang, phrase, k, a, c, array_to_string(p[:c], ' ') AS head, array_to_string(p[c + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, l.f AS l, r.f AS r, n, c, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.phrase = head JOIN f AS r ON r.lang = cuts.lang AND r.phrase = tail JOIN n ON n.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst) WHERE rank <= 2000
"""


@R.query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@R.query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
