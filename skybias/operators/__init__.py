"""DataFrame -> DataFrame operators. Lazy, except model fitting and writes."""
