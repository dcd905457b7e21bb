"""sources of the trajectory jobs."""
