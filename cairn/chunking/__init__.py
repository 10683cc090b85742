"""Source texts to structural chunks and raw edges, one file at a time."""
