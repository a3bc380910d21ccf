"""Assigning new sequences to known representatives as they arrive."""
