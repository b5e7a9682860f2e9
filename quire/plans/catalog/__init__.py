"""The registered queries, one module per area of the library."""
