"""Manifest and job plans."""
