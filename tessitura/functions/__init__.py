"""Tessitura functions."""
