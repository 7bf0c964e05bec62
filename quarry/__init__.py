"""Set-at-a-time analytics over trace-augmented code graphs, and training-data operators, on Spark."""
