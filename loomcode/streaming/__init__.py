"""Change notices as a stream."""
