"""Corpus operators: deduplication, filters, language and toxicity models, token files and packing."""
