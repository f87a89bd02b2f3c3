"""Composed plans: the full feature frame, training and scoring."""
