"""Relational operators over documents, chunks, query logs and feeds."""
