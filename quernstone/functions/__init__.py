"""Column functions for cleanup and profiling."""
