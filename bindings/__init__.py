"""Binds the engine's operators to the given tables, each with the same result in plain SQL."""
