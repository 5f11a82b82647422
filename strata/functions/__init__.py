"""Column functions: paths, labels, periods and source-code lines."""
