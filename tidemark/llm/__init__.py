"""Training-data operators: filters, deduplication, tokenizers and classifiers.

Nothing outside this folder imports it.
"""
