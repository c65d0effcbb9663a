"""Jobs of the ticketing model, and the registered queries."""
