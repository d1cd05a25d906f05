"""Column functions: quantile rules, hashes, checked parsing and display."""
