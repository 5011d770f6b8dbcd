"""Readers and writers of the mission's files."""
