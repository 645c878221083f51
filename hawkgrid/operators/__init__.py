"""DataFrame-in, DataFrame-out operators; thresholds are keyword arguments."""
