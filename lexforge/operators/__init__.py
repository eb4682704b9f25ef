"""Relational operators: counts, probabilities, enrichment, tags, suggestions, fusion, evaluation, datasets."""
