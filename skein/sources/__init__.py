"""Where files and lines come from, and where tables go."""
