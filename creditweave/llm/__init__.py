"""Operators for the preparation of training data from text; nothing outside this subpackage imports it."""
