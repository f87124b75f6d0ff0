"""Readers that land source files as document rows."""
