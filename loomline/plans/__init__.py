"""Queries over the tables, evaluation, budgets and incremental recomputation."""
