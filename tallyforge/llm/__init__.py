"""Operators for training data made of language; nothing outside this subpackage imports it."""
