"""streaming of lodeline."""
