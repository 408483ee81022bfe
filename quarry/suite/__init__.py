"""The operators run over the test tables, each with SQL that says the same.

Roles of the tables: ``documents`` are code documents (``source`` is the
repository, ``lang`` stands for a programming language), ``embeddings`` are
code vectors (``label`` is the language) or token vectors (``vec_id`` is the
token id), ``benchmark`` holds text queries, ``labels`` relevance, ``events``
the query log, ``supplier`` repositories.
"""

from quarry.suite import (
    catalogue, corpus, evaluation, forest, publication, scalars, search, sequences, sources, training, vocabulary,
)

MODULES = [scalars, corpus, vocabulary, sequences, search, forest, publication, evaluation, training, catalogue, sources]


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
