"""Column helpers: durations, time grid, JSON paths, conditions, maps and text."""
