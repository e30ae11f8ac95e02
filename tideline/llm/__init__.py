"""Corpus-preparation operators for language-model training data.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only if it is present.
"""
