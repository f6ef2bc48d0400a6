"""Operators composed into whole phases."""
