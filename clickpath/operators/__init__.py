"""DataFrame operators: histories, sessions, features, recommenders, metrics."""
