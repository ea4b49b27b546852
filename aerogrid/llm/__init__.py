"""Training-data operators on documents, pages and conversations.

Nothing else in the library imports this subpackage; its queries are registered in `queries.py`.
"""
