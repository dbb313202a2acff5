"""Query plans: the registry of named queries over the test bindings and their SQL oracles."""
