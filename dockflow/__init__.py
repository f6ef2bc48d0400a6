"""Dock-network analytics on Spark: trips in, labelled station-hours, features and models out."""

__version__ = "0.1.0"
