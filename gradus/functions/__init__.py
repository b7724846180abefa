"""Column functions of degrees: connectives, fuzzy sets, similarities."""
