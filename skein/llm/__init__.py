"""Training-data operators: dedup, decontamination, toxicity, PII, packing and file formats.

Nothing outside this folder imports it.
"""
