"""Training-data operators: tokens, secrets, licences, near copies, packing and vector search."""
