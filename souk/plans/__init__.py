"""Query plans: the models, dashboards and the registry of named queries."""
