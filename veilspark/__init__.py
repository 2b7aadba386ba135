"""veilspark: a Spark-native security-analytics engine over text, tool calls and tool metadata."""
