"""Query bindings on the driver tables (one module per area) and their oracles."""
