"""Readers of agent histories: JSON values with byte places, lines, chunks, database cells, and stores on disk."""
