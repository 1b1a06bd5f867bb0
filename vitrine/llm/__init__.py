"""Operators for building text training data: duplicates, quality, licences,
secrets, tokens and source mixing.  Nothing else in the library imports this
subpackage; ``queries.py`` registers its queries."""
