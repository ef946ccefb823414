"""Operators over memory states."""
