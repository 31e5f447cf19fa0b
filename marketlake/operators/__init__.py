"""Batch operators. Clock values and the evaluation date are arguments; nothing here collects."""
