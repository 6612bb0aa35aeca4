"""evloom: a PySpark-native engine for timestamped multimodal evidence."""
