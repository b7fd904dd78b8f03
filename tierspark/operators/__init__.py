"""DataFrame operators: features, normalisation, clustering, medians, scoring."""
