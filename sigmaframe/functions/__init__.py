"""Column functions: element-wise arithmetic, activations and complex numbers."""
