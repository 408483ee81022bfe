"""Tokenising, encoding and decoding with the learnt vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators import encoding as K
from quarry.plans import prepare as P
from quarry.session import materialise
from quarry.suite.common import (
    CODE_DOCS, TEXT_QUERIES, code_documents, joined, quote, sql_joined, sql_normal_code,
    sql_normal_query, text_queries, table,
)
from quarry.suite.vocabulary import (
    CODE_VOCAB, SIZE, both_vocabularies, code_counts, code_vocabulary, sql_counts, sql_vocabulary,
)


def subword_tokenize(spark, folder):
    """Pieces of every distinct out-of-vocabulary word."""
    counts = materialise(code_counts(spark, folder), "counts")
    vocabulary = code_vocabulary(spark, folder)
    from quarry.operators.vocabulary import out_of_vocabulary

    words = out_of_vocabulary(counts, vocabulary).select("scope", "token")
    return K.subword_tokenise(words, vocabulary).select(
        "scope", "token", joined(F.col("pieces")).alias("pieces")
    )


def tokenize(spark, folder):
    docs = code_documents(spark, folder)
    tokens = K.tokenise(docs, ["doc_id"], code_vocabulary(spark, folder))
    return tokens.select("doc_id", "scope", F.size("pieces").alias("n"), joined(F.col("pieces")).alias("pieces"))


def _encoded(spark, folder, reverse=False):
    docs = code_documents(spark, folder)
    return K.encode(docs, ["doc_id"], code_vocabulary(spark, folder), C.CODE_LENGTH, reverse)


def encode_pad(spark, folder):
    return _encoded(spark, folder).select("doc_id", "scope", joined(F.col("ids")).alias("ids"))


def encode_reverse(spark, folder):
    return _encoded(spark, folder, True).select("doc_id", "scope", joined(F.col("ids")).alias("ids"))


def decode(spark, folder):
    """Encoded documents back to text: cut words vanish, padding shows."""
    vocabulary = code_vocabulary(spark, folder)
    encoded = K.encode(code_documents(spark, folder), ["doc_id"], vocabulary, C.CODE_LENGTH)
    return K.decode(encoded, ["doc_id"], vocabulary)


def conversation_pairs(spark, folder):
    """(query, code) pairs: a user turn and the assistant's next one."""
    turns = table(spark, folder, "conversations")
    user = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query")
    )
    code = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("code"))
    return user.join(code, ["conv_id", "turn"]).withColumn(
        "row_id", F.col("conv_id") * 1000 + F.col("turn")
    )


def pair_documents(spark, folder):
    """The pairs as preprocessed documents of one language and all sets."""
    from quarry.functions import text as T
    from quarry.operators.corpus import split_set

    pairs = conversation_pairs(spark, folder)
    language = F.lit("python")
    return pairs.select(
        "row_id",
        language.alias("language"),
        split_set(F.col("row_id"), seed=3).alias("set"),
        T.normalised_query_tokens(T.text_query_tokens(F.col("query"))).alias("query_tokens"),
        T.normalised_code_tokens(language, T.code_tokens(language, F.col("code"))).alias("code_tokens"),
    )


def pair_vocabulary(spark, folder):
    return P.prepare_vocabularies(pair_documents(spark, folder), SIZE)


def valid_seqs(spark, folder):
    """Pairs of encoded turns in which both sides hold a real token."""
    documents = pair_documents(spark, folder)
    vocabulary = P.prepare_vocabularies(documents, SIZE)
    return P.prepare_sequences(documents, "row_id", vocabulary).select(
        "row_id", joined(F.transform("query_ids", lambda i: F.when(i != 0, 1).otherwise(0))).alias("mask")
    )


def prepare_seqs(spark, folder):
    """Sequences of the pairs in their sets, and once more in set ``all``."""
    documents = pair_documents(spark, folder)
    vocabulary = P.prepare_vocabularies(documents, SIZE)
    every = documents.withColumns({"set": F.lit("all"), "row_id": -F.col("row_id") - 1})
    sequences = P.prepare_sequences(documents.unionByName(every), "row_id", vocabulary)
    return sequences.select(
        "row_id", "set", joined(F.col("code_ids")).alias("code_ids"),
        joined(F.col("query_ids")).alias("query_ids"),
    )


def prepare_steps(spark, folder):
    """Vocabularies and sequences as two runs of one step each over the pairs."""
    documents = materialise(pair_documents(spark, folder), "pairs")
    vocabulary = P.prepare(None, "row_id", SIZE, steps=("vocabularies",), preprocessed=documents)["vocabularies"]
    done = P.prepare(None, "row_id", SIZE, steps=("sequences",), preprocessed=documents, vocabulary=vocabulary)
    return done["sequences"].select(
        "row_id", "set", joined(F.col("code_ids")).alias("code_ids"), joined(F.col("query_ids")).alias("query_ids")
    )


QUERIES = {
    f.__name__: f
    for f in [
        subword_tokenize, tokenize, encode_pad, encode_reverse, decode, valid_seqs, prepare_seqs, prepare_steps,
    ]
}


# --- The same in SQL ------------------------------------------------------------


def sql_walk(p: str) -> str:
    """CTE ``{p}pieces(scope, token, pieces)`` of all words in ``{p}oov``, by a
    recursive walk that takes the longest known piece at each place."""
    unk, sow, eow = quote(C.UNK), quote(C.SOW), quote(C.EOW)
    return f"""{p}longest AS (
  SELECT s.scope, s.token, s.start, max(s.size) AS size FROM {p}spans s
  JOIN {p}bpe b ON b.scope = s.scope AND b.token = substr(s.token, s.start, s.size) GROUP BY ALL),
{p}walk AS (
  SELECT scope, token, 1::BIGINT AS start FROM {p}oov WHERE length(token) > 0
  UNION ALL
  SELECT w.scope, w.token, w.start + coalesce(l.size, 1) FROM {p}walk w
  LEFT JOIN {p}longest l ON l.scope = w.scope AND l.token = w.token AND l.start = w.start
  WHERE w.start + coalesce(l.size, 1) <= length(w.token)),
{p}found AS (
  SELECT w.scope, w.token, w.start,
    CASE WHEN l.size IS NULL THEN {unk} ELSE substr(w.token, w.start, l.size) END AS piece
  FROM {p}walk w
  LEFT JOIN {p}longest l ON l.scope = w.scope AND l.token = w.token AND l.start = w.start),
{p}pieces AS (
  SELECT o.scope, o.token, [{sow}] || coalesce(list(f.piece ORDER BY f.start) FILTER (f.piece IS NOT NULL), []) || [{eow}] AS pieces
  FROM {p}oov o LEFT JOIN {p}found f ON f.scope = o.scope AND f.token = o.token GROUP BY ALL),
{p}lookup AS (
  SELECT scope, token, arg_min(id, CASE kind WHEN 'word' THEN 0 ELSE 1 END)::INTEGER AS id FROM {p}vocab GROUP BY ALL)"""


def sql_encode(name: str, p: str, source: str, key: str, length: int) -> str:
    """CTE ``{name}(key, scope, pieces, ids)`` of the token lists in a CTE.

    Words outside ``{p}oov`` and ``{p}words`` must not occur.
    """
    return f"""{name}_tokens AS (
  SELECT {key}, scope, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {source}),
{name}_parts AS (
  SELECT t.{key}, t.scope, t.pos, coalesce(x.pieces, [t.token]) AS pieces FROM {name}_tokens t
  LEFT JOIN {p}pieces x ON x.scope = t.scope AND x.token = t.token),
{name}_flat AS (
  SELECT {key}, scope, pos, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS sub FROM {name}_parts),
{name}_ids AS (
  SELECT f.{key}, f.scope, list(f.piece ORDER BY pos, sub) AS pieces,
    list(coalesce(l.id, 1) ORDER BY pos, sub) AS ids
  FROM {name}_flat f LEFT JOIN {p}lookup l ON l.scope = f.scope AND l.token = f.piece GROUP BY ALL),
{name} AS (
  SELECT s.{key}, s.scope, coalesce(i.pieces, []) AS pieces,
    list_resize(coalesce(i.ids, [])[1:{length}], {length}, 0) AS ids
  FROM {source} s LEFT JOIN {name}_ids i ON i.{key} = s.{key} AND i.scope = s.scope)"""


CODE_ENCODED = ",\n".join(
    [CODE_VOCAB, sql_walk("c_"), sql_encode("encoded", "c_", "code_docs", "doc_id", C.CODE_LENGTH)]
)

PAIRS = f"""pairs AS (
  SELECT u.conv_id * 1000 + a.turn AS row_id, u.text AS query, a.text AS code
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
pair_docs AS (
  SELECT row_id, {sql_normal_query("string_split(query, ' ')")} AS query_tokens,
    {sql_normal_code("'python'", 'lexed')} AS code_tokens,
    CASE WHEN share < 0.8 THEN 'train' WHEN share < 0.9 THEN 'valid' ELSE 'test' END AS "set"
  FROM (SELECT *, ('0x' || substr(md5('3:' || row_id), 1, 7))::BIGINT / 268435456e0 AS share,
      regexp_extract_all(code, {quote("|".join([C.LEX_HASH_COMMENT, C.LEX_STRING, C.LEX_WORD, C.LEX_NUMBER, C.LEX_SYMBOL]))}) AS lexed
    FROM pairs))"""

# Words of other sets than train are spelled too, so the walk starts from all.
PAIR_ENCODED = f"""{PAIRS},
p_train AS (
  SELECT 'python' AS scope, code_tokens AS tokens FROM pair_docs WHERE "set" = 'train'
  UNION ALL SELECT 'query', query_tokens FROM pair_docs WHERE "set" = 'train'),
{sql_counts('p_counts', 'p_train')},
{sql_vocabulary('t_', 'p_counts', SIZE)},
p_all AS (
  SELECT 'python' AS scope, code_tokens AS tokens FROM pair_docs
  UNION ALL SELECT 'query', query_tokens FROM pair_docs),
p_vocab AS (SELECT * FROM t_vocab),
p_bpe AS (SELECT * FROM t_bpe),
p_oov AS (
  SELECT DISTINCT scope, token FROM (SELECT scope, unnest(tokens) AS token FROM p_all) c
  WHERE NOT EXISTS (SELECT 1 FROM t_words w WHERE w.scope = c.scope AND w.token = c.token)),
p_spans AS (
  SELECT scope, token, start, unnest(range(1, least({C.NGRAM_MAX}, length(token) - start + 1) + 1)) AS size
  FROM (SELECT *, unnest(range(1, length(token) + 1)) AS start FROM p_oov)),
{sql_walk('p_')},
p_code AS (SELECT row_id, 'python' AS scope, code_tokens AS tokens FROM pair_docs),
p_query AS (SELECT row_id, 'query' AS scope, query_tokens AS tokens FROM pair_docs),
{sql_encode('pc', 'p_', 'p_code', 'row_id', C.CODE_LENGTH)},
{sql_encode('pq', 'p_', 'p_query', 'row_id', C.QUERY_LENGTH)}"""

_PAIR_SEQUENCES = f"""
SELECT row_id, d."set", {sql_joined('pc.ids')} AS code_ids, {sql_joined('pq.ids')} AS query_ids
FROM pc JOIN pq USING (row_id) JOIN pair_docs d USING (row_id)
WHERE len(list_filter(pc.ids, lambda i: i <> 0)) > 0 AND len(list_filter(pq.ids, lambda i: i <> 0)) > 0"""

SQL = {
    "subword_tokenize": f"""
WITH RECURSIVE {CODE_VOCAB}, {sql_walk('c_')}
SELECT scope, token, {sql_joined('pieces')} AS pieces FROM c_pieces""",
    "tokenize": f"""
WITH RECURSIVE {CODE_ENCODED}
SELECT doc_id, scope, len(pieces)::INTEGER AS n, {sql_joined('pieces')} AS pieces FROM encoded""",
    "encode_pad": f"""
WITH RECURSIVE {CODE_ENCODED} SELECT doc_id, scope, {sql_joined('ids')} AS ids FROM encoded""",
    "encode_reverse": f"""
WITH RECURSIVE {CODE_ENCODED}
SELECT doc_id, scope, {sql_joined('list_reverse(ids)')} AS ids FROM encoded""",
    "decode": f"""
WITH RECURSIVE {CODE_ENCODED},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS place FROM encoded_flat),
used AS (SELECT * FROM placed WHERE place <= {C.CODE_LENGTH}),
whole AS (
  SELECT p.doc_id, p.pos, p.scope, len(p.pieces) AS n, p.pieces FROM encoded_parts p),
words AS (
  SELECT u.doc_id, u.pos, string_agg(CASE WHEN w.n = 1 OR (u.sub > 1 AND u.sub < w.n) THEN u.piece END, '' ORDER BY u.sub) AS word
  FROM used u JOIN whole w USING (doc_id, pos) GROUP BY u.doc_id, u.pos, w.n HAVING count(*) = w.n),
texts AS (
  SELECT doc_id, list(word ORDER BY pos) FILTER (word <> '') AS words FROM words GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM used GROUP BY doc_id)
SELECT d.doc_id, d.scope, array_to_string(coalesce(words, []) ||
  list_resize([]::VARCHAR[], {C.CODE_LENGTH} - coalesce(n, 0), '{C.PAD}'), ' ') AS text
FROM code_docs d LEFT JOIN texts USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "valid_seqs": f"""
WITH RECURSIVE {PAIR_ENCODED}
SELECT row_id, array_to_string(list_transform(pq.ids, lambda i: CASE WHEN i <> 0 THEN 1 ELSE 0 END), '|') AS mask
FROM pq JOIN pc USING (row_id) JOIN pair_docs d USING (row_id)
WHERE len(list_filter(pc.ids, lambda i: i <> 0)) > 0 AND len(list_filter(pq.ids, lambda i: i <> 0)) > 0""",
    "prepare_steps": f"WITH RECURSIVE {PAIR_ENCODED}{_PAIR_SEQUENCES}",
    "prepare_seqs": f"""
WITH RECURSIVE {PAIR_ENCODED}{_PAIR_SEQUENCES}
UNION ALL
SELECT -row_id - 1, 'all', {sql_joined('ids')}, NULL FROM pc""",
}
