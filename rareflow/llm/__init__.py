"""Training-data operators: scoring, filtering, matching, tokenizing, ordering and packing of documents.

Each module holds one operator with its own interface; ``queries`` applies them to the standard tables.
"""
