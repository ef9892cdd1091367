"""Training-data operators: scoring, deduplication, decontamination, privacy, formatting and mixing.

Nothing outside this subpackage imports it.  Each operator module has a general interface over any
DataFrame with the named columns; ``queries`` holds the fixed queries over the test tables.
"""
