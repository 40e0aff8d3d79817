"""Column expressions: projection, epipolar geometry, kernels."""
