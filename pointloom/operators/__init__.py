"""Operators on clouds: DataFrames with pid, x, y, z and, where they have them, nx, ny, nz and r, g, b."""
