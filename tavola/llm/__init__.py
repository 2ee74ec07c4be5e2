"""Operators for preparing training data at scale; queries are in ``queries``."""
