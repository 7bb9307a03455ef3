"""DataFrame operators: cleaning, metrics, features, clustering."""
