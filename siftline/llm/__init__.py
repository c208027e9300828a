"""Training-data operators: PII surrogates, token stores, decontamination, extraction,
token counts, line and document de-duplication, quality rules and subword encoding.

Nothing outside this subpackage imports it.
"""
