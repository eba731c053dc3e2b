"""Relational building blocks of the queries."""
