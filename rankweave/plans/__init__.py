"""Plans: what the operators are composed into, and the registered queries."""
