"""Operators composed into complete analyses."""
