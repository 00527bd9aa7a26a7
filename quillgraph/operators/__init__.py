"""DataFrame-to-DataFrame operators on citation graphs, candidate windows and score tables."""
