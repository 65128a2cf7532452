"""Evidence-backed document facts on Spark: DataFrame operators over tables of pages and texts."""
