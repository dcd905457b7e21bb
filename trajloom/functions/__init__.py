"""functions of the trajectory jobs."""
