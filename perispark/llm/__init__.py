"""Operations of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` wires them to the given tables.
"""
