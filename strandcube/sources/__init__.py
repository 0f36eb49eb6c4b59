"""Readers, writers and the synthetic feed generator."""
