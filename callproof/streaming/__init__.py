"""The row-wise checks on a stream of calls."""
