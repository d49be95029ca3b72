"""Streams of the activity log."""
