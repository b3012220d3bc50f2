"""Predicates and driver-side planners."""
