"""textwarden: a Spark-native text-risk analytics engine."""
