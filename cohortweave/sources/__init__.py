"""Readers and writers of corpora, session logs and phase outputs."""
