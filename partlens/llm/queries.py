"""The queries opN_<name>: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm import embeddings, extract, mixing, packing, piece_codec, pseudo_likelihood, quality, simhash, suffixes, token_counts, urls, variants, whitening
from partlens.llm.registry import query, read

_WORD = r"'[^\x20\x09-\x0D]+'"

_MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size,
    CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS sk, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt
  FROM documents
), classed AS (
  SELECT *, size - size % (1 << greatest(0, length(bin(size)) - 6)) AS class FROM sized
), sums AS (SELECT sk, sum(size) AS source_size, row_number() OVER (ORDER BY sk) AS turn FROM classed GROUP BY sk
), caps AS (SELECT *, [1, 2, 3][(turn - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM sums
), filled AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM caps WINDOW o AS (ORDER BY cap::DOUBLE / weight, sk)
), first AS (SELECT min_by({{'place': place, 'rest': rest, 'shares': shares}}, place) AS f FROM filled WHERE rest * weight <= cap * shares
), goals AS (
  SELECT sk, source_size, ('0x' || substr(md5('{mixing.SEED}/' || sk), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start,
    CASE WHEN place < f.place THEN cap::DOUBLE ELSE (weight * f.rest)::DOUBLE / f.shares::DOUBLE END AS target
  FROM filled, first
), placed AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY class, salt, size, doc_id NULLS FIRST)::DOUBLE AS place FROM classed
), stepped AS (
  SELECT doc_id, size, source_size, target, start, place, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate
  FROM placed JOIN goals USING (sk)
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (size * least(floor(start + place * rate) - floor(start + (place - 1) * rate), 3))::BIGINT AS taken
FROM stepped
"""


@query("op1_mixing", _MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _quality_sql() -> str:
    values = ", ".join(f"{{'measure': '{m}', 'v': ({e.replace(' div ', ' // ')})}}" for m, (e, _) in quality.MEASURES.items())
    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s) in quality.MEASURES.items()) + " END"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lang IS NULL THEN 'b' ELSE 'a' || lang END AS lk,
    CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS sk, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, {blanks}) <> ''] AS lines
  FROM documents
), windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM rows WHERE len(w) >= 8)
), twice AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM windows) WHERE n > 1
), covered AS (SELECT rid, sum(least(coalesce(j - i, 8), 8)) AS n FROM twice GROUP BY rid
), measured AS (
  SELECT rid, doc_id, lk, sk, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(text) - len(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols, len(text) - len(translate(text, '!?', '')) AS n_shouts,
    len(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len([i FOR i IN range(1, len(w)) IF w[i] = w[i + 1]]) AS n_echoes, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM rows LEFT JOIN covered c USING (rid)
), based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), valued AS (SELECT rid, lk, sk, unnest([{values}], recursive := true) FROM based WHERE NOT base_failed
), sketch AS (SELECT lk, sk, measure, v - v % (1 << greatest(0, length(bin(v)) - 6)) AS bucket, count(*) AS n FROM valued GROUP BY ALL
), levels AS (SELECT unnest([lk || '/' || sk, lk || '/', '/']) AS level, measure, bucket, n FROM sketch
), summed AS (SELECT level, measure, bucket, sum(n) AS n FROM levels GROUP BY ALL
), ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, measure) AS total, sum(n) OVER (PARTITION BY level, measure ORDER BY bucket) AS upto FROM summed
), quartiles AS (
  SELECT level, measure, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM ranked GROUP BY ALL
), edges AS (
  SELECT level, measure, total, q1 - greatest({slack}, {quality.WIDTHS} * (q3 - q1)) AS lo, q3 + greatest({slack}, {quality.WIDTHS} * (q3 - q1)) AS hi FROM quartiles
), chosen AS (
  SELECT lk, sk, measure, min_by(lo, rank) AS lo, min_by(hi, rank) AS hi
  FROM (SELECT DISTINCT lk, sk, unnest([{{'rank': 0, 'level': lk || '/' || sk}}, {{'rank': 1, 'level': lk || '/'}}, {{'rank': 2, 'level': '/'}}], recursive := true) FROM sketch)
  JOIN edges USING (level) WHERE total >= {quality.GROUP_DOCS} OR rank = 2 GROUP BY ALL
), judged AS (SELECT rid, bool_and(v BETWEEN lo AND hi) AS inside FROM valued JOIN chosen USING (lk, sk, measure) GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, FALSE) AS kept
FROM based LEFT JOIN judged USING (rid)
"""


@query("op2_quality", _quality_sql())
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def piece_model() -> str:
    """The public vocabulary that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op3_extract")
def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op4_pieces")
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(read(spark, sf_dir, "documents"), piece_model()).withColumnRenamed("id", "doc_id")


@query("op5_hnsw")
def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op6_suffixes")
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_URL_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(verdict, rule, h, p) AS (VALUES %s
), fits AS (
  SELECT page_id, host, path, max_by({'rule': rule, 'verdict': r.verdict}, length(rule)) AS f
  FROM parts LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM fits
""" % ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in urls.RULES)


@query("op7_urls", _URL_SQL)
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op8_pseudo_likelihood")
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_counts")
def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), piece_model(), budget=4096)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), F.col("fits").alias("chars_within_limit"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


@query("op11_variants")
def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


def byte_vocabulary() -> str:
    """The public vocabulary that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), byte_vocabulary())


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
