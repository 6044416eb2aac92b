"""Queries over the shared tables and the SQL they are checked against."""
