"""gristmill: a Spark-native analytics engine for task-difficulty studies."""
