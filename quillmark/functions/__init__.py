"""Column functions: every one is an expression of built-in functions unless it says so."""
