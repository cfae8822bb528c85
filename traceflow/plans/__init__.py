"""Registered queries: an operator over a view of the driver tables, and the same in SQL."""
