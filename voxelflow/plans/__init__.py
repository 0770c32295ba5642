"""Registered queries with their SQL and validation rules."""
