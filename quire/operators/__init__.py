"""Operators on positioned page content."""
