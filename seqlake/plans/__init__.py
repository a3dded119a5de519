"""Query plans: the catalogue of registered queries and the tables they run on."""
