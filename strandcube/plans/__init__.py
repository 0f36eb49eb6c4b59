"""Cube specification, measure layer and cuboid routing."""
