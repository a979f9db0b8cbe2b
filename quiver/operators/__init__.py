"""DataFrame -> DataFrame operators: dataset shaping (S4-S9), derived
features (P10, P12-P14), wide bucketizing (P3-P9, P16, P17, P20, P23),
multi-horizon counters (X1-X5), sequences."""
