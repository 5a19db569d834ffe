"""Column expressions: everything here is a builtin-function expression unless its name says so."""
