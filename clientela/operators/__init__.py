"""Building blocks shared by the products."""
