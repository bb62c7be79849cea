"""voxelmill: 3-D spatial analytics on PySpark DataFrames."""
