"""ledgerloom: contract and corpus analytics expressed as Spark DataFrames."""
