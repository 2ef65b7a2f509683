"""Whole jobs: sources, operators and outputs put together."""
