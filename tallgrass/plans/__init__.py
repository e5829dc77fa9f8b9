"""Plan building blocks shared by the operators: staging and skew-safe lookups."""
