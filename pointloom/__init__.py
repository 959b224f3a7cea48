"""Point-cloud analytics on Spark: clouds, meshes, voxels and features as DataFrames."""
