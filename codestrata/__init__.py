"""Analysis of source-code corpora as Spark jobs over tables of files."""
