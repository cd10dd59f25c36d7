"""Path tables that grow by micro-batches."""
