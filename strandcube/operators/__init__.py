"""Distributed operators (DataFrame in, lazy DataFrame out)."""
