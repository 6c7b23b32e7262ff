"""Operators for text corpora: tokens, languages, duplicates, leaks, private data and toxicity."""
