"""DataFrame operators: cleaning, hierarchy, backtests, covariance, reconciliation, gate, metrics, tests, counts."""
