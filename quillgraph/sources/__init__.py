"""Readers and writers: JSON lines, embeddings, GEXF, archives."""
