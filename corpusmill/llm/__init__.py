"""Operators for preparing training text: language, copies, lines, packing,
tokens, models, secrets, quality, fingerprints and mixing."""
