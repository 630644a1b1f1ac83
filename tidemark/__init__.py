"""tidemark: bars, features, labels, rule layers and ledgers as Spark DataFrames."""
