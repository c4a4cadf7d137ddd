"""Training-data operators: quality, decontamination, archives, tokens, extraction, near-duplicates.

Nothing else in the library imports this subpackage.
"""
