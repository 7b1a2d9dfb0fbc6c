"""Column functions: contact data, text formats, labels, exact rounding."""
