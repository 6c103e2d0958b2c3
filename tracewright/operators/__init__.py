"""Jobs over ledgers: normalisation, import, routing, reads, retrieval, provenance, lifecycles and checks."""
