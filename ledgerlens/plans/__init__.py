"""Query plans: the registered queries (reading the star schema) and their SQL oracles."""
