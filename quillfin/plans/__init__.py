"""Analyses built from operators."""
