"""Graph operators: patterns, navigation, paths, closures, statistics, generation."""
