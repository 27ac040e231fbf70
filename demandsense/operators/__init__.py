"""DataFrame operators, one module per stage."""
