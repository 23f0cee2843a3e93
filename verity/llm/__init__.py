"""Operators of a training-data pipeline: encoding, fingerprints, extraction,
packing, near-duplicates, chat formatting, language ID, quality rules, line
dedup and sharding. Nothing outside this subpackage imports it."""
