"""The operators, by field; importing this package registers all of them."""

from popspark.operators import demography, differentiation, distances, diversity, haplotypes, intervals, linkage, patterns, quality, sequences, statistics, structure, tables  # noqa: F401
