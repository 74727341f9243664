"""Physical layout helpers: durable cuts of lineage and distributed ordering."""
