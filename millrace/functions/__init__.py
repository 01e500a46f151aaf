"""Column functions: everything here is a Catalyst expression, none a Python function at run time."""
