"""Tessitura: a Spark-native engine for music-library resolution and play-history analytics."""
