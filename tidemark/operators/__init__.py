"""Contracts, expectations and merges."""
