"""Operators for training-data corpora: archives, duplicates, sampling, token files, filters."""
