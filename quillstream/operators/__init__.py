"""Operators that combine rows: keyed state, IP range join, filters."""
