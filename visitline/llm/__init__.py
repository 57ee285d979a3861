"""Operators for building training corpora: extraction, scoring, deduplication, mixing and scans."""
