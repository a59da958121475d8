"""Data-processing operators over whole tables."""
