"""Operators for preparing training data: de-duplication, mixing, scoring, masking, search and packing."""
