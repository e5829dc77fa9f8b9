"""Streams: rules on arriving rows, and windowed quality counts."""
