"""Column expressions on 3-vectors, rotations, dense solves on the driver, number formatting."""
