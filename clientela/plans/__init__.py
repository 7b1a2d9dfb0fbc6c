"""The products, one module per area."""
