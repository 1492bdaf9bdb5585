"""Whole analyses composed from the operators: the atlas build, diversity models, extrapolation."""
