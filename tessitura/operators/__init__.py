"""Tessitura operators."""
