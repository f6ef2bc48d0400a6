"""Test tables mapped onto the engine's inputs, the registered queries and their SQL."""
