"""Relational operators: gathers, pair joins, budgets, counts and their like over whole tables."""
