"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import byte_bpe, collocations, embedding_dedup, language_id, line_dedup, packing, ranked_search, sharding, simhash, substring_dedup, suffix_dedup, token_counts as counting, topk

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.token_counts(_table(spark, folder, "documents"), WORD_TOKENIZER)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.learn(docs.where("not held_out"))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits")


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents"), window=50)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("span_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.repeated_lines(_table(spark, folder, "documents"), edits=2, min_bytes=24, equal_bytes=1)
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return sharding.shuffled_shards(docs, 8).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode(_table(spark, folder, "documents"), BYTE_RANKS, offsets=False, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"), 0.93)


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, folder, "documents"), WORD_TOKENIZER)
    return packing.best_fit(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"), width=3, radius=2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, folder, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"), max_words=4, min_count=30, top=2000)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op3_suffix_array_dedup": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM docs)),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE first_doc < doc_id),
marked AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh
  FROM gone),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run),
cut AS (
  SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM spans),
kept AS (
  SELECT c.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_b,
    string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY run) AS head
  FROM cut c JOIN docs USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last_b, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""",
    "op4_line_dedup": f"""
WITH split_docs AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, number, parts[number + 1] AS line
  FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS number FROM split_docs)),
some_lines AS (SELECT * FROM lines WHERE strlen(line) >= 24 OR regexp_matches(line, '[^\\x09-\\x0D\\x20]')),
places AS (SELECT line, min((doc_id, number)) AS first FROM some_lines GROUP BY line),
counted AS (
  SELECT line, first, strlen(line) AS n, {", ".join(f"strlen(line) - strlen(replace(line, '{c}', '')) AS c{i}" for i, c in enumerate("etanhors "))}
  FROM places WHERE strlen(line) >= 24),
-- Lines within two edits differ by at most two in length and in each letter's count.
near AS (
  SELECT DISTINCT b.line FROM counted a JOIN counted b ON a.first < b.first AND b.n BETWEEN a.n - 2 AND a.n + 2
    AND {" AND ".join(f"abs(a.c{i} - b.c{i}) <= 2" for i in range(9))}
  WHERE levenshtein(a.line, b.line) <= 2),
gone AS (
  SELECT doc_id, number FROM some_lines JOIN places USING (line)
  WHERE (doc_id, number) <> first OR line IN (SELECT line FROM near)),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS removed
  FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  coalesce(removed, '') AS removed
FROM split_docs LEFT JOIN listed USING (doc_id)""",
    "op7_exact_top_k": """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ids AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_ids l ON l.a = vec_id LEFT JOIN degree d ON d.a = vec_id""",
    "op11_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM places WHERE p + 19 <= len(w)),
firsts AS (SELECT s, min((doc_id, p)) AS first FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM windows JOIN firsts USING (s) WHERE (doc_id, p) > first),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w[p], ' ' ORDER BY p) AS text
  FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""",
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split_pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM split_pieces),
grams AS (
  SELECT lang, k, w[p:p + k - 1] AS g, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE p + k - 1 <= len(w) GROUP BY ALL),
counted AS (SELECT * FROM grams WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.k, c.g, c.f AS a, h.f AS l, t.f AS r, h.k AS first_words,
    CAST(2000000 AS HUGEINT) * c.f // (CAST(h.f AS HUGEINT) + t.f) AS score
  FROM counted c JOIN counted h ON h.lang = c.lang AND h.k < c.k AND h.g = c.g[1:h.k]
  JOIN counted t ON t.lang = c.lang AND t.k = c.k - h.k AND t.g = c.g[h.k + 1:c.k]),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, first_words) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.g FROM counted s JOIN (
    SELECT lang, f, k, g, unnest(range(1, k + 1)) AS x FROM counted WHERE k > 2) b
  ON b.lang = s.lang AND s.k >= 2 AND s.k < b.k AND x + s.k - 1 <= b.k AND b.g[x:x + s.k - 1] = s.g
  WHERE 100 * b.f >= 80 * s.f),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM lowest ANTI JOIN inside USING (lang, g))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked
JOIN (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split_pieces GROUP BY lang) USING (lang)
WHERE rank <= 2000""",
    "op13_ranked_search": r"""
WITH own AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM own WHERE len(w) > 0),
sized AS (
  SELECT doc_id, w, CAST(100 - 75 + (75 * len(w) * n_docs) // n_terms AS BIGINT) AS m FROM own, totals WHERE len(w) > 0),
spread AS (SELECT doc_id, m, unnest(w) AS term FROM sized),
postings AS (
  SELECT doc_id, m, term, count(*) AS tf FROM spread WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM postings, totals GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10""",
}
