"""Readers and writers for annotation tables, media files, logs and collections."""
