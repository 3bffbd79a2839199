"""Operators for preparing training text: joins of near copies, scoring, packing, filtering, encoding and fingerprints."""
