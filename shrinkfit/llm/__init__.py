"""Training-data operators: search, language ID, chat formatting, dedup, mixing, packing, archives.

Nothing else in the library imports this subpackage. Every operator works on whole
tables and whole texts; each module's docstring states what it does with nulls,
empty and very long texts, ties, repeated rows and empty tables.
"""
