"""Plan shaping shared by all operators: shared tables, components, skew, prefix sums."""
