"""Fixtures, registered queries and the pipeline of stages."""
