"""functions of lodeline."""
