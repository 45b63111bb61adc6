"""Moves tables and change feeds from a source model into a target model on Spark."""

__version__ = "0.1.0"
