"""Operators for preparing training corpora: packing, decontamination, dedup, PII, scoring.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
