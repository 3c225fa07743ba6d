"""Whole answers: SQL over the registered tables, and a question mapped to its report."""
