"""plans of the trajectory jobs."""
