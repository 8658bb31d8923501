"""Plan shapes shared by the operators: held tables and skew-safe lookups."""
