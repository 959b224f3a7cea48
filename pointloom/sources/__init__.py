"""XYZ and PLY files: Spark data sources for reading, single-file writers, and dispatch by format."""
