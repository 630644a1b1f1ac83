"""Operators for building training corpora, each over whole tables of documents."""
