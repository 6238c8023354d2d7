"""Validation: each rule is a query that returns its violations."""
