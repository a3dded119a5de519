"""Training-data operators: quality, archives, scoring, mixing, chat, language, decontamination, dedup, PII.

Nothing outside this subpackage imports it.
"""
