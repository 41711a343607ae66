"""Readers and writers of alignment, hit, structure and result files."""
