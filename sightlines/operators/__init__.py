"""DataFrame operators over the occurrence tables."""
