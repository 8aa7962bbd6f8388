"""Readers of landing files, and the shared folder."""
