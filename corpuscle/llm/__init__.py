"""Operators for the preparation of training data, each usable on any DataFrame of documents."""
