"""Operators of a training-data pipeline: filters, joins, dedup, packing, search and tokenising.

Every operator takes and returns DataFrames; ``catalog`` registers one query per operator.
Nothing outside this folder, ``corpus_pipeline.py`` and the entry point imports it.
"""
