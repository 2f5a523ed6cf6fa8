"""Plans: end-to-end tasks and the registered queries."""
