"""Operators for preparing training data: mixing, scoring, search, counting,
sharding, decontamination, near-duplicates, chat rendering, language and quality.

The subpackage is self-contained; nothing else in the library imports it.
"""
