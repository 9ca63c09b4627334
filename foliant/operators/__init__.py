"""Relational operators: predicates, parent counts, scoring, term lists, views, reports."""
