"""Training-data pipeline operators (documents, pages, embeddings).

Nothing else in the library imports this subpackage; ``queries`` holds its
registered queries and their SQL.
"""
