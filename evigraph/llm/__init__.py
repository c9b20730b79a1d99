"""Training-data operators: filters, classifiers, tokenisers, deduplication, search and mixing.

Nothing else in the library imports this package.
"""
