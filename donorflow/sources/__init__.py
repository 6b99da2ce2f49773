"""Typed readers, writers and schema checks."""
