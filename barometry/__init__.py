"""Market-regime analytics as Spark jobs: bars, macro and options in, regimes and alerts out."""
