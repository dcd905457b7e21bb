"""streaming of the trajectory jobs."""
