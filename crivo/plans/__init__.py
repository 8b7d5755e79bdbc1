"""End-to-end screening plans and the registered queries."""
