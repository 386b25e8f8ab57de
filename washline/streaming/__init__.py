"""Applying a fitted cleaner to a stream."""
