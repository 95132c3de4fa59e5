"""retort: Spark-native curation of molecular, assay and text datasets."""
