"""Operators for preparing training data of language and recommendation models."""
