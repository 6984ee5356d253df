"""DataFrame to DataFrame operators over pixels, regions, clusters and paths."""
