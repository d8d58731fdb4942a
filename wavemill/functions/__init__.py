"""Column expressions and the small numpy kernels that tasks call."""
