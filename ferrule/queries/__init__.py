"""Registered queries, by domain."""
