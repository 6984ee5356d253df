"""NumPy kernels for what depends on an order of steps; each works on one image."""
