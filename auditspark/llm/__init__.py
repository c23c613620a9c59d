"""Operators that prepare training text: deduplication, packing, decontamination,
quality and toxicity models, language identification, surrogates and extraction.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only
when the folder is there.
"""
