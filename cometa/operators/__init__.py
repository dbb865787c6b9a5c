"""DataFrame operators: audit rules, statistics, ML preparation, metrics, geo."""
