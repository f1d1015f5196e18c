"""Whole runs and their start-up checks."""
