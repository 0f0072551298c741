"""quillspark: Spark-native article extraction, retrieval and scoring."""
