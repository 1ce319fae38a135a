"""Tessitura streaming."""
