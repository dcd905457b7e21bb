"""operators of the trajectory jobs."""
