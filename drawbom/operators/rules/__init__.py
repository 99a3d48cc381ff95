"""Quoting rules: settings, validation, sizing, catalog search and parts."""
