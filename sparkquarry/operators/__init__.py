"""DataFrame operators: sections, chunks, enrichment, entities, queries, search, answers."""
