"""Operators for preparing training text: contamination, duplicates, licences, quality, tokens, chat, personal data."""
