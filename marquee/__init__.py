"""Catalog, text and vector analytics as functions from DataFrame to DataFrame."""
