"""Operators for preparing training text: duplicates, rules, tokens, packing, languages, archives and vectors."""
