"""Fixed-purpose Column functions: regular-expression dialect, repair, comparison, JSON values, keys, money."""
