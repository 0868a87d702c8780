"""sources of lodeline."""
