"""Training-data operators: ten corpus operators and the pipeline built on them.

Nothing outside this package imports it.  ``catalog.py`` registers one query per
operator; ``oracle.py`` holds the DuckDB SQL of those that SQL can express.
"""
