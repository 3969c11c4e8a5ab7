"""Relational operators on corpora: bags of n-grams, metadata, vocabularies, matrices, vectors, topics, nested entries."""
