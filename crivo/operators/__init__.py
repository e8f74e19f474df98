"""DataFrame operators: audit, profile, sampling, similarity, metrics, models."""
