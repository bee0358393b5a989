"""Training-data operators: tokens, quality, toxicity, languages, duplicates, packing.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only
when it can be imported.
"""
