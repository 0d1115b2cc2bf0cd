"""Operators of a training-data pipeline over text tables: sharding, near-duplicate join, archives,
main-text extraction, decontamination, chat formatting, quality rules and models, tokenization."""
