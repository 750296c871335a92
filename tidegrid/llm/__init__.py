"""Operations for preparing large text corpora: deduplication, tokenising, mixing, classifying.

Nothing outside this package imports it.
"""
