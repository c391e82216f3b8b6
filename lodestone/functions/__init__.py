"""Column expressions: scalar functions, bases, kernels, distributions."""
