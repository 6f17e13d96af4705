"""Relational building blocks shared by the query plans."""
