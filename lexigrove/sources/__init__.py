"""Readers and writers of corpora, vectors, histories and pages."""
