"""Query plans: fixture views, registered queries and their SQL twins."""
