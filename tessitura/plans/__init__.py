"""Tessitura plans."""
