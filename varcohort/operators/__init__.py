"""Operators over variants, genotypes, intervals, frequencies, scores and series."""
