"""Record matching on Spark: generate, dirty, pair, request, decide, evaluate, report."""
