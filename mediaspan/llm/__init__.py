"""Operators for large text corpora: packing, decontamination, deduplication, language, PII, counts, filters."""
