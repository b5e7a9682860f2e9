"""Readers, gates and writers at the edge of the library."""
