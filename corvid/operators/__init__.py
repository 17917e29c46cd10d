"""Relational operators: frames in, frames out, keyed by query id."""
