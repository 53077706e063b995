"""Operators for large training corpora: quality, personal data, secrets, near copies, sharding, tokens and chat."""
