"""Operators that Spark has no single function for, composed of DataFrame operations."""
