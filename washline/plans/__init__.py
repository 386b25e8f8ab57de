"""Cleaning plans: suggesting, checking, ordering and running them."""
