"""Tessitura sources."""
