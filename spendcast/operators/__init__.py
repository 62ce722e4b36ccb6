"""DataFrame operators: ordered prefix sums, labels, features, encoding, folds, metrics."""
