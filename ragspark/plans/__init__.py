"""Operators composed into whole retrieval, coverage and session plans."""
