"""Catalog search and conversation analytics as DataFrame operators."""
