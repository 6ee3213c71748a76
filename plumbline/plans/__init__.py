"""Shapes: their form, how they are read from a shapes graph, and how they become plans."""
