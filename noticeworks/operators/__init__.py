"""DataFrame operators on the model tables."""
