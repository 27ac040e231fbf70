"""Feed readers and writers, and adapters from a star schema."""
