"""Readers and writers for corpus tables."""
