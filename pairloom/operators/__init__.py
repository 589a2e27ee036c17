"""DataFrame -> DataFrame operators: pair features, graphs, models, post-processing."""
