"""Weft: lattice disambiguation and corpus preparation on Spark."""
