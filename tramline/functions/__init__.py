"""Scalar expressions on feed text."""
