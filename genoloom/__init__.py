"""Genotype-panel analytics and large-scale text operators on Spark."""
