"""Readers and writers of scene descriptions and tiled results."""
