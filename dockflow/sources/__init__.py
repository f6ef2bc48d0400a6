"""Readers and download planning."""
