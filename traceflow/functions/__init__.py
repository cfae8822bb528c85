"""Column functions over sample arrays, and small NumPy kernels."""
