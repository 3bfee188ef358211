"""Relational operators: the table twins of the array verbs, and document operators."""
