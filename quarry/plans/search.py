"""The three searches, each over a whole table of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quarry import constants as C
from quarry.functions import text as T, vectors as V
from quarry.operators.embedding import Model, embed
from quarry.operators.encoding import encode
from quarry.operators.forest import Forest
from quarry.operators.neighbours import VectorIndex, nearest, nearest_to_stored
from quarry.plans.prepare import published_index, published_model
from quarry.session import materialise
from quarry.sources.catalogue import log_queries, repository_languages, with_cache
from quarry.sources.publication import REPOSITORY, Snapshot


def query_problem(query: Column, longest: int = C.MAX_QUERY_CHARS) -> Column:
    """Why a query is rejected; null for a good one."""
    return F.when(
        query.isNull() | (F.length(T.strip_blank(query)) == 0), "invalid or missing"
    ).when(F.length(query) > longest, "too long")


def code_problem(code: Column, known_language: Column) -> Column:
    return F.coalesce(
        query_problem(code, C.MAX_CODE_CHARS), F.when(~known_language, "unknown language")
    )


def requested_languages(queries: DataFrame, repository_languages: DataFrame, by: list[str]) -> DataFrame:
    """Languages to search per query: the filter's, if it names any, else all
    of the repository. ``problem`` marks a filter without a valid language."""
    named = T.filter_languages(F.col("query"))
    # In the order the filter names them, once each.
    both = F.array_intersect(named, F.col("languages"))
    chosen = F.when(named.isNull(), F.col("languages")).otherwise(both)
    return (
        queries.join(repository_languages, by)
        .withColumn("searched", chosen)
        .withColumn(
            "problem",
            F.when(F.size("searched") == 0, "no valid language in the filter"),
        )
        .drop("languages")
    )


def embed_queries(
    queries: DataFrame, vocabulary: DataFrame, model: Model, length: int = C.QUERY_LENGTH
) -> DataFrame:
    """Embeddings of typed queries (query_id, query); ``scope`` is optional."""
    if "scope" not in queries.columns:
        queries = queries.withColumn("scope", F.lit("query"))
    tokens = T.normalised_query_tokens(T.text_query_tokens(T.without_filter(F.col("query"))))
    encoded = encode(
        queries.select("query_id", "scope", tokens.alias("tokens")), ["query_id"], vocabulary, length
    )
    return embed(encoded, ["query_id"], model).drop("scope")


def embed_code(
    snippets: DataFrame,
    keys: list[str],
    vocabulary: DataFrame,
    model: Model,
    length: int = C.CODE_LENGTH,
) -> DataFrame:
    """Embeddings of source text: ``keys``, ``language`` and ``code``; the
    vocabulary scope is the language unless ``scope`` says otherwise."""
    if "scope" not in snippets.columns:
        snippets = snippets.withColumn("scope", F.col("language"))
    language = F.col("language")
    tokens = T.normalised_code_tokens(language, T.code_tokens(language, F.col("code")))
    encoded = encode(
        snippets.select(*keys, "scope", tokens.alias("tokens")), keys, vocabulary, length
    )
    return embed(encoded, keys, model)


def with_documents(hits: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with their documents, best first and ties by row.

    The hits are written first: few rows of known size, so the documents are
    met by a broadcast while that holds and by a shuffle beyond.
    """
    angular = V.angular_distance(F.col("distance"))
    return (
        materialise(hits, "hits")
        .join(documents, keys)
        .select(
            "query_id",
            *keys,
            "url",
            "code_hash",
            T.basename(F.col("path")).alias("filename"),
            "rank",
            angular.alias("distance"),
            V.match_rating(angular).alias("rating"),
        )
        .orderBy("query_id", "distance", "row_index")
    )


def grouped(df: DataFrame, by: list[str]) -> DataFrame:
    """``language`` as one key that names the repository too."""
    return df.withColumn("language", F.concat_ws("/", *by, "language")) if by else df


def _plain_language(results: DataFrame) -> DataFrame:
    return results.withColumn("language", F.substring_index("language", "/", -1))


def checked_queries(queries: DataFrame, repository_languages: DataFrame, by: list[str]) -> DataFrame:
    """All requests with ``searched``, the languages to search, and ``problem``,
    null for those that are searched."""
    known = repository_languages.select(*by, "languages")
    named = queries.join(known, by, "left").withColumn("_known", F.col("languages").isNotNull())
    named = named.withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
    asked = requested_languages(named.drop("languages"), named.select("query_id", "languages"), ["query_id"])
    return asked.withColumn("problem", F.coalesce(
        query_problem(F.col("query")), F.when(~F.col("_known"), "unknown repository"), "problem"
    )).drop("_known")


def checked_snippets(snippets: DataFrame, repository_languages: DataFrame, by: list[str]) -> DataFrame:
    """All requests (query_id, language, code) with ``problem``, null for good ones."""
    has = F.coalesce(F.array_contains("languages", F.col("language")), F.lit(False))
    return snippets.join(repository_languages.select(*by, "languages"), by, "left").withColumn(
        "problem",
        F.coalesce(query_problem(F.col("code"), C.MAX_CODE_CHARS),
                   F.when(F.col("languages").isNull(), "unknown repository"), code_problem(F.col("code"), has)),
    ).drop("languages")


def checked_hashes(requests: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """All requests (query_id, code_hash) with ``problem``, null for stored hashes."""
    held = documents.select(*by, "code_hash", F.lit(True).alias("_held")).distinct()
    return requests.join(held, [*by, "code_hash"], "left").withColumn(
        "problem", F.when(F.col("_held").isNull(), "unknown document")
    ).drop("_held")


def _asked_scopes(model: Model, vocabulary: DataFrame, asked: DataFrame) -> tuple[Model, DataFrame]:
    """Model and vocabulary of the scopes that are asked for."""
    scopes = materialise(asked.select("scope").distinct(), "scopes")
    return Model(*[part.join(scopes, "scope", "left_semi") for part in model]), vocabulary.join(scopes, "scope", "left_semi")


def _neighbours(
    items: DataFrame | None, by: list[str], vectors: DataFrame, k: int, index: Forest | None, search_k: int | None
) -> DataFrame:
    """Exact over ``items``, or by an index whose languages name the repository."""
    if index is not None:
        return index.search(vectors, k, search_k)
    return nearest(grouped(items, by), vectors, k)


def text_search(
    queries: DataFrame,
    repository_languages: DataFrame,
    by: list[str],
    items: DataFrame | None,
    documents: DataFrame,
    vocabulary: DataFrame,
    model: Model,
    k: int = C.WEB_RESULTS,
    own_models: bool = False,
    index: Forest | None = None,
    search_k: int | None = None,
    log: str | None = None,
) -> DataFrame:
    """Text to code for every accepted query, in its own repository.

    ``by`` names the repository columns shared by all tables. Scopes are those
    of one model for all, or with ``own_models`` each repository's own. Requests
    that :func:`checked_queries` finds a problem with have no rows here; every
    well-formed query goes to the ``log``.
    """
    checked = materialise(checked_queries(queries, repository_languages, by), "checked")
    if log is not None:
        log_queries(checked.where(query_problem(F.col("query")).isNull()), log)
    scope = F.concat_ws("/", *by, F.lit("query")) if own_models else F.lit("query")
    asked = materialise(checked.where("problem is null").withColumn("scope", scope), "asked")
    keys = F.transform("searched", lambda name: F.concat_ws("/", *by, name))
    if own_models:
        model, vocabulary = _asked_scopes(model, vocabulary, asked)
    vectors = embed_queries(asked.select("query_id", "scope", "query"), vocabulary, model)
    wanted = vectors.join(asked.select("query_id", keys.alias("languages")), "query_id")
    hits = _neighbours(items, by, wanted, k, index, search_k)
    return _plain_language(
        with_documents(hits, grouped(documents, by), ["language", "row_index"])
    )


def code_search(
    snippets: DataFrame,
    repository_languages: DataFrame,
    by: list[str],
    items: DataFrame | None,
    documents: DataFrame,
    vocabulary: DataFrame,
    model: Model,
    k: int = C.WEB_RESULTS,
    own_models: bool = False,
    index: Forest | None = None,
    search_k: int | None = None,
) -> DataFrame:
    """Code to code within the snippet's own repository and language; requests
    that :func:`checked_snippets` finds a problem with have no rows here."""
    checked = checked_snippets(snippets, repository_languages, by)
    key = F.concat_ws("/", *by, "language")
    good = materialise(checked.where("problem is null").withColumn("scope", key if own_models else F.col("language")), "snippets")
    if own_models:
        model, vocabulary = _asked_scopes(model, vocabulary, good)
    vectors = embed_code(good.select("query_id", "scope", "language", "code"), ["query_id"], vocabulary, model)
    wanted = vectors.drop("scope").join(good.select("query_id", F.array(key).alias("languages")), "query_id")
    hits = _neighbours(items, by, wanted, k, index, search_k)
    return _plain_language(
        with_documents(hits, grouped(documents, by), ["language", "row_index"])
    )


def similar_documents(
    requests: DataFrame,
    items: DataFrame | None,
    documents: DataFrame,
    k: int = C.WEB_RESULTS,
    by: list[str] | None = None,
    index: Forest | None = None,
    search_k: int | None = None,
) -> DataFrame:
    """Documents like stored ones: requests are (query_id, code_hash) and the
    repository columns ``by``; only that repository is looked at.

    A hash stored more than once asks for each of its documents, so
    ``query_id`` of the result names language and row of the document too.
    """
    by = by or []
    whole = grouped(documents, by)
    stored = requests.select("query_id", "code_hash", *by).join(
        whole.select("code_hash", "language", "row_index", *by), ["code_hash", *by]
    ).select(
        F.concat_ws(":", F.col("query_id").cast("string"), "language", F.col("row_index").cast("string"))
        .alias("query_id"),
        "language",
        "row_index",
    )
    if index is not None:
        hits = index.search_stored(stored, k, search_k)
    else:
        hits = nearest_to_stored(grouped(items, by), stored, k)
    return _plain_language(with_documents(hits, whole, ["language", "row_index"]))


def published_languages(snapshot: Snapshot) -> DataFrame:
    """The languages of every published repository."""
    return repository_languages(snapshot.table("code_document").select(*REPOSITORY, "language").distinct())


def published_text_search(snapshot: Snapshot, queries: DataFrame, k: int = C.WEB_RESULTS, **options) -> DataFrame:
    """Text search over what is published: requests are (query_id, organization,
    name, query); each repository's own model and index answer."""
    documents, vocabulary = snapshot.table("code_document"), snapshot.table("vocabulary").drop(*REPOSITORY)
    return text_search(
        queries, published_languages(snapshot), REPOSITORY, None, documents, vocabulary, published_model(snapshot),
        k, own_models=True, index=published_index(snapshot), **options,
    )


def published_code_search(snapshot: Snapshot, snippets: DataFrame, k: int = C.WEB_RESULTS, **options) -> DataFrame:
    """Code search over what is published: (query_id, organization, name, language,
    code)."""
    documents, vocabulary = snapshot.table("code_document"), snapshot.table("vocabulary").drop(*REPOSITORY)
    return code_search(
        snippets, published_languages(snapshot), REPOSITORY, None, documents, vocabulary, published_model(snapshot),
        k, own_models=True, index=published_index(snapshot), **options,
    )


def published_similar(snapshot: Snapshot, requests: DataFrame, k: int = C.WEB_RESULTS, **options) -> DataFrame:
    """Documents like stored ones: (query_id, organization, name, code_hash)."""
    documents = snapshot.table("code_document")
    return similar_documents(requests, None, documents, k, REPOSITORY, published_index(snapshot), **options)


#: A stored answer: the columns of :func:`with_documents` by key.
ANSWERS = (
    "cache_key string, query_id string, language string, row_index long, url string, code_hash string, "
    "filename string, rank int, distance double, rating double"
)


def answered(requests: DataFrame, key: Column, cache: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``search`` for every request, from the ``cache`` where it has
    them. Equal requests are searched once and each gets the results. Nothing
    expires: after a refresh of what is searched the cache is to be cleared."""
    keyed = materialise(requests.withColumn("cache_key", key), "keyed")

    def compute(misses: DataFrame) -> DataFrame:
        once = misses.where("cache_key is not null").dropDuplicates(["cache_key"])
        found = search(once.withColumn("query_id", F.col("cache_key")).drop("cache_key"))
        # Requests for similar documents name language and row after the key.
        return found.withColumn("cache_key", F.substring_index("query_id", ":", 1))

    found = with_cache(keyed, cache, ANSWERS, compute)
    suffix = F.substr("query_id", F.length("cache_key") + 1)
    asked = keyed.select(F.col("query_id").alias("_asked"), "cache_key")
    whole = F.when(suffix == "", F.col("_asked").cast("string")).otherwise(F.concat(F.col("_asked").cast("string"), suffix))
    return found.join(asked, "cache_key").withColumn("query_id", whole).drop("_asked", "cache_key")


def cached_text_search(snapshot: Snapshot, queries: DataFrame, cache: str, k: int = C.WEB_RESULTS, **options) -> DataFrame:
    """:func:`published_text_search` through a cache; ``query_id`` comes back as a string."""
    key = T.cache_key("query", F.col("organization"), F.col("name"), F.col("query"))
    return answered(queries, key, cache, lambda asked: published_text_search(snapshot, asked, k, **options))


def cached_similar(snapshot: Snapshot, requests: DataFrame, cache: str, k: int = C.WEB_RESULTS, **options) -> DataFrame:
    """:func:`published_similar` through a cache."""
    key = T.cache_key("similar", F.col("organization"), F.col("name"), F.col("code_hash"))
    return answered(requests, key, cache, lambda asked: published_similar(snapshot, asked, k, **options))


def predict(
    queries: DataFrame,
    items: DataFrame | None,
    documents: DataFrame,
    vocabulary: DataFrame,
    model: Model,
    k: int = C.EVALUATION_RESULTS,
    index: VectorIndex | None = None,
    probes: int = 4,
) -> DataFrame:
    """The best ``k`` documents of every language for every text query.

    As deep as the evaluation goes by default; the command line asks for 30.
    Exact over ``items``, or approximate by an ``index``.
    """
    vectors = embed_queries(queries, vocabulary, model)
    hits = nearest(items, vectors, k) if index is None else index.search(vectors, k, probes)
    return (
        materialise(hits, "hits")
        .join(documents.select("language", "row_index", "identifier", "url"), ["language", "row_index"])
        .join(queries.select("query_id", "query"), "query_id")
        .select("query_id", "query", "language", "identifier", "url", "rank", "distance")
    )
