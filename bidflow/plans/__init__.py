"""The auction queries, word counts and the registry of runnable queries."""
