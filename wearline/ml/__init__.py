"""Learning as dataflow: splits, folds, Spark ML pipelines, search, importance, attribution."""
