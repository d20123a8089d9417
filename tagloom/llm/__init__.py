"""Operators of a training-data pipeline: one module each, tied to queries in ``queries``."""
