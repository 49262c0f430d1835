"""Rule-learning analytics over DataFrames."""
