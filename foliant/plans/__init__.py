"""Request bodies to plans, and the registered queries."""
