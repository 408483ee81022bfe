"""Preparing corpora, vocabularies and sequences; refreshing repositories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.operators import corpus
from quarry.operators.embedding import Model, embed, initial_model, warm_start
from quarry.operators.encoding import encode, valid_pair
from quarry.operators.forest import Forest
from quarry.operators.ranking import row_numbers
from quarry.operators.training import fit, scope_name
from quarry.operators.vocabulary import fit_vocabulary, merge_vocabularies, token_counts
from quarry.session import materialise, materialise_by
from quarry.sources.catalogue import stored_documents
from quarry.sources.publication import REPOSITORY, Snapshot, mark, publish


def prepare_corpora(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Preprocessed documents of all languages and sets in one job."""
    return corpus.preprocess(documents, keep)


def prepare_vocabularies(
    preprocessed: DataFrame,
    size: int = C.VOCABULARY_SIZE,
    bpe_share: float = C.BPE_SHARE,
    owner: Column | None = None,
) -> DataFrame:
    """A code vocabulary per language and one pooled query vocabulary from
    the training set; with an ``owner`` (a repository), one set of them each."""
    owner = F.lit("") if owner is None else owner
    train = preprocessed.filter(F.col("set") == "train")
    sides = [(F.col("language"), "code_tokens"), (F.lit("query"), "query_tokens")]
    code, query = [
        token_counts(train.select(scope_name(owner, scope).alias("scope"), F.col(name).alias("tokens")))
        for scope, name in sides
    ]
    return fit_vocabulary(code.unionByName(query), size, bpe_share)


def prepare_sequences(
    preprocessed: DataFrame,
    key: str,
    vocabulary: DataFrame,
    code_length: int = C.CODE_LENGTH,
    query_length: int = C.QUERY_LENGTH,
    normalise: Callable[[Column, Column], Column] = T.normalised_code_tokens,
    owner: Column | None = None,
) -> DataFrame:
    """Id sequences of every document and set.

    With an ``owner`` each owner's documents use its own vocabularies.

    Set ``all`` keeps every code sequence and has no query sequence; the
    others keep pairs in which both sides hold a real token.
    """
    both = encoded_sides(preprocessed, key, vocabulary, code_length, query_length, normalise, owner)
    # One filter, so that both encodings are planned once.
    return both.filter((F.col("set") == "all") | valid_pair(F.col("code_ids"), F.col("query_ids")))


def encoded_sides(
    preprocessed: DataFrame,
    key: str,
    vocabulary: DataFrame,
    code_length: int = C.CODE_LENGTH,
    query_length: int = C.QUERY_LENGTH,
    normalise: Callable[[Column, Column], Column] = T.normalised_code_tokens,
    owner: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Code sequences of all rows; query sequences of those in no set ``all``."""
    language = F.col("language")
    owner = F.lit("") if owner is None else owner
    code = encode(
        preprocessed.select(
            key, scope_name(owner, language).alias("scope"), normalise(language, F.col("code_tokens")).alias("tokens")
        ),
        [key], vocabulary, code_length, name="code_ids",
    ).drop("scope")
    query = encode(
        preprocessed.filter(F.col("set") != "all").select(
            key, scope_name(owner, F.lit("query")).alias("scope"),
            T.normalised_query_tokens(F.col("query_tokens")).alias("tokens"),
        ),
        [key], vocabulary, query_length, name="query_ids",
    ).drop("scope")
    kept = preprocessed.select(key, "set", "language", owner.alias("owner"), *(keep or []))
    return code.join(kept, key).join(query, key, "left")


def prepare(
    documents: DataFrame,
    key: str,
    size: int = C.VOCABULARY_SIZE,
    bpe_share: float = C.BPE_SHARE,
    steps: tuple[str, ...] = ("corpora", "vocabularies", "sequences"),
    preprocessed: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The chosen preparation steps; left-out ones take their given result."""
    done: dict[str, DataFrame] = {}
    if "corpora" in steps:
        preprocessed = materialise(prepare_corpora(documents, [key, "set"]), "preprocessed")
        done["corpora"] = preprocessed
    if "vocabularies" in steps:
        vocabulary = prepare_vocabularies(preprocessed, size, bpe_share)
        done["vocabularies"] = vocabulary
    if "sequences" in steps:
        done["sequences"] = prepare_sequences(preprocessed, key, vocabulary)
    return done


def for_owners(base: DataFrame, scopes: DataFrame) -> DataFrame:
    """A base table's rows once for each owner's scope of the same name."""
    named = scopes.select(
        F.col("scope").alias("owner_scope"), F.substring_index("scope", "/", -1).alias("scope")
    )
    return base.join(named, "scope").drop("scope").withColumnRenamed("owner_scope", "scope")


#: Published tables, and what they are laid out by besides the repository.
PUBLISHED = {
    "code_document": [], "vocabulary": [], "tokens": [], "gate": [], "norms": [],
    "index_vectors": ["bucket"], "index_nodes": ["bucket"], "index_groups": [],
}


def with_repository(df: DataFrame, named: str) -> DataFrame:
    """``organization`` and ``name`` from a column that begins with them."""
    parts = F.split(named, "/")
    return df.withColumns({"organization": parts[0], "name": parts[1]})


def published_model(snapshot: Snapshot) -> Model:
    return Model(*[snapshot.table(part).drop(*REPOSITORY) for part in Model._fields])


def published_index(snapshot: Snapshot) -> Forest:
    tables = [snapshot.table(f"index_{part}").drop(*REPOSITORY) for part in ("vectors", "nodes", "groups")]
    return Forest(*tables)


def update_repositories(
    files: DataFrame,
    extractor: Callable[[DataFrame], DataFrame],
    target: str,
    base_vocabulary: DataFrame | None = None,
    base_model: Model | None = None,
    minimum: int = C.MIN_SAMPLES_PER_LANGUAGE,
    size: int = C.VOCABULARY_SIZE,
    width: int = C.EMBEDDING_SIZE,
    n_trees: int = C.REPOSITORY_TREES,
    retry: bool = False,
    **training,
) -> DataFrame:
    """Refresh all given repositories, every stage one job for all of them.

    ``files`` has organization, name, commit_hash, path and text. Extract,
    gate by sample count, number, split, learn each repository's vocabularies
    and merge them into the base, warm start, fit each repository's encoders,
    embed, index, publish. All are marked as in progress first. Documents,
    vocabulary, model and index of the good ones appear together in one
    version; a repository that fails the gate gets the error status and keeps
    what it had, and repositories that are not in ``files`` are not touched.
    Those in error from before are left out, unless ``retry`` is set. If the
    run itself fails, all of its repositories get the error status and keep
    what they had. Returns each repository's status.
    """
    spark = files.sparkSession
    if not retry:
        failed = Snapshot.current(spark, target).manifest.where(F.col("update_status") == C.UPDATE_ERROR)
        # Of a known size, so that the files need not move for it.
        files = files.join(materialise(failed.select(*REPOSITORY), "failed"), REPOSITORY, "left_anti")
    given = materialise(files.select(*REPOSITORY, "commit_hash").groupBy(*REPOSITORY).agg(F.max("commit_hash").alias("commit_hash")), "given")
    mark(spark, target, given, C.UPDATE_IN_PROGRESS)
    try:
        status, tables = _refreshed(
            files, given, extractor, base_vocabulary, base_model, minimum, size, width, n_trees, training
        )
        publish(spark, target, tables, status, PUBLISHED)
    except Exception:
        mark(spark, target, given, C.UPDATE_ERROR)
        raise
    return status


def _refreshed(
    files: DataFrame, given: DataFrame, extractor: Callable, base_vocabulary: DataFrame | None,
    base_model: Model | None, minimum: int, size: int, width: int, n_trees: int, training: dict,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Status of the repositories and the tables to publish.

    Texts and their tokens are written once, in buckets of a key, and are not
    moved until they are published: copies, the gate, numbers and sets are
    settled on narrow rows, which meet the wide ones by the key.
    """
    owner = F.concat_ws("/", *REPOSITORY)
    by, place = [*REPOSITORY, "commit_hash", "language"], ["path", "start_line", "code_hash"]
    # Several definitions may stand on one line; their content tells them apart.
    doc_key = F.sha1(F.concat_ws("\n", *REPOSITORY, "language", "path", F.col("start_line").cast("string"), "code_hash"))
    with_key = lambda df: df.withColumn("key", F.unhex(F.sha1(F.concat_ws("\n", doc_key, "commit_hash"))))
    whole = F.lit(True)
    for name in (*by, *place):
        whole &= F.col(name).isNotNull()
    found = corpus.extracted(files, extractor).withColumn("code_hash", F.sha1("code"))
    stored = [*REPOSITORY, "commit_hash", "path", "code", "start_line", "end_line", "code_hash"]
    wide = materialise_by(with_key(corpus.preprocess(found, stored)).drop("url"), "key", "extracted")
    first = corpus.first_places(wide, by, "code_hash", ["path", "start_line"])
    places = materialise(with_key(first.where(whole)), "places")
    gate = corpus.sample_gate(places, REPOSITORY, minimum)
    # A repository without any document fails too.
    status = materialise(
        given.join(gate, REPOSITORY, "left").withColumns({
            "fewest": F.coalesce("fewest", F.lit(0)),
            "update_status": F.coalesce("update_status", F.lit(C.UPDATE_ERROR)),
        }),
        "status",
    )
    accepted = places.join(
        status.filter(F.col("update_status") == C.UPDATE_FINISHED), REPOSITORY, "left_semi"
    )
    numbers = materialise(
        row_numbers(accepted.drop("commit_hash"), [*REPOSITORY, "language"], [*place, "key"]).drop(*place), "numbers"
    )
    # Rows that are equal in place and content are one.
    numbered = wide.where(whole).join(numbers.select("key", "row_index"), "key").dropDuplicates(["key"])
    # Documents with query tokens are in a set, and all of them in the set of all.
    chosen = F.when(F.size("query_tokens") > 0, corpus.split_set(doc_key)).otherwise("all")
    preprocessed = numbered.withColumns({"owner": owner, "set": chosen, "doc_key": doc_key})
    vocabulary = prepare_vocabularies(preprocessed, size, owner=F.col("owner"))
    if base_vocabulary is not None and base_model is not None:
        scopes = materialise(vocabulary.select("scope").distinct(), "scopes")
        merged = materialise(
            merge_vocabularies(for_owners(base_vocabulary, scopes), vocabulary), "merged"
        )
        vocabulary = merged.drop("base_id")
        base = Model(*[for_owners(part, scopes) for part in base_model])
        model = warm_start(base, merged, width)
    else:
        vocabulary = materialise(vocabulary, "vocabulary")
        model = initial_model(vocabulary, width)
    # A document is encoded once for both of its sets.
    both = F.array(F.col("set"), F.lit("all"))
    paired = (F.col("set") != "all") & valid_pair(F.col("code_ids"), F.col("query_ids"))
    encoded = materialise(
        encoded_sides(preprocessed, "key", vocabulary, owner=F.col("owner"), keep=["doc_key"]).withColumn(
            "sets", F.when(paired, both).otherwise(F.array(F.lit("all")))
        ),
        "sequences",
    )
    sequences = encoded.withColumn("set", F.explode("sets")).drop("sets").withColumns({
        "row_id": F.concat_ws(":", "doc_key", "set"),
        "query_ids": F.when(F.col("set") != "all", F.col("query_ids")),
    })
    if training.get("max_epochs", 1):
        model, _ = fit(
            sequences.filter(F.col("set") == "train"),
            sequences.filter(F.col("set") == "valid"),
            model,
            **{
                "patience": C.REPOSITORY_PATIENCE,
                "evaluation_batch": C.REPOSITORY_EVALUATION_BATCH,
                **training,
            },
        )
    embedded = embed(
        encoded.withColumn("scope", F.concat_ws("/", "owner", "language")), ["key"], model, ids="code_ids"
    ).drop("scope")
    items = numbers.select("key", F.concat_ws("/", *REPOSITORY, "language").alias("language"), "row_index").join(embedded, "key")
    index = Forest.grow(items.drop("key"), n_trees=n_trees)
    tables = {"code_document": stored_documents(numbered), "vocabulary": with_repository(vocabulary, "scope")}
    tables |= {part: with_repository(df, "scope") for part, df in model._asdict().items()}
    tables |= {
        "index_vectors": with_repository(index.vectors, "language"),
        "index_nodes": with_repository(index.nodes, "part"),
        "index_groups": with_repository(index.groups, "language"),
    }
    return status, tables
