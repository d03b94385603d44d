"""Operators for preparing training data at scale: counting, decontamination, formatting, filtering, deduplication,
mixing, scanning and scoring of documents. Nothing else in the library imports this subpackage."""
