"""Graph-style analytics over code and text corpora, written as Spark DataFrame plans."""
