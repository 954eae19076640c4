"""End-to-end module chains and the query catalog."""
