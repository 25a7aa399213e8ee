"""Table operators: versions, histories, upserts, the clickstream clean layer, data-quality checks."""
