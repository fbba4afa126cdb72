"""Readers and writers of reports, corpora and findings."""
