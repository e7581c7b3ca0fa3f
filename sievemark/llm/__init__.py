"""Training-data operators: counting, packing, mixing, filtering, de-duplication and search over document corpora.

Nothing else in the library imports this subpackage.
"""
