"""Analytics of judged language-model evaluations, as Spark DataFrames."""
