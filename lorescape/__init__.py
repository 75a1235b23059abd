"""lorescape: a Spark-native engine for searching, linking and maintaining Markdown knowledge bases."""
