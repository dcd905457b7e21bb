"""Trajectory reduction and corpus preparation jobs for PySpark."""
