"""Training-data operators: ten Spark operators over documents, pages and embeddings.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their SQL.
"""
