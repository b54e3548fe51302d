"""Fitting in batches as frames arrive."""
