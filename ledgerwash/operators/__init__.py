"""DataFrame operators: the cleaning pipeline and data-quality checks."""
