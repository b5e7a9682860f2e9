"""Plan shapes shared by the operators, and the flows built from them."""
