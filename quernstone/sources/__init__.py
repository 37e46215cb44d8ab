"""Readers of messy exports."""
