"""Targets, paths and constraints as DataFrame operators."""
