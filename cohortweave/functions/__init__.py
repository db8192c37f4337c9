"""Column functions, all native expressions."""
