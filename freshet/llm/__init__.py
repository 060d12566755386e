"""Training-data operators: counting, joining, cleaning, scoring, mixing and sharding a text corpus."""
