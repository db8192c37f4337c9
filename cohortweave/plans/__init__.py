"""End-to-end phases composed from the operators."""
