"""Layers after their edits, written as files that map editors and Spark read."""
