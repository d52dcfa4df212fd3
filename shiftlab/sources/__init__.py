"""Readers and writers of cubes, and synthetic data."""
