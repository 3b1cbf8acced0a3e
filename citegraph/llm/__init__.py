"""Training-data operators (secret scans, tokens, quality, dedup, mixing ...).

Nothing else in the library imports this subpackage.
"""
