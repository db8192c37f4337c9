"""Operators for preparing training data: quality, secrets, personal data, duplicates, tokens, packing, archives."""
