"""Simulation and selection of galaxy catalogs as Spark DataFrame operators."""
