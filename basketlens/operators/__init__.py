"""Relational operators: identity stitching, order facts, customer facts,
traffic/conversion, statistics, and skew-safe sequence numbering."""
