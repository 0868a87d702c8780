"""plans of lodeline."""
