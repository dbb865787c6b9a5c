"""Query plans: registered queries, job flows and join strategy helpers."""
