"""Disclosure analytics on Spark."""
