"""Operators for building training data: matching, survivors, packing,
leak search and subjects.  Nothing outside this folder imports it."""
