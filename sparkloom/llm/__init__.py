"""Operators for preparing training text: dedup, PII, licences, toxicity, scoring, WARC, search, BPE, mixing.

Nothing outside this folder imports it.
"""
