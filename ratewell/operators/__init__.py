"""DataFrame operators: columns, ranks, splits, profiles, features, evaluation."""
