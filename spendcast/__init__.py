"""Customer spend features and scoring, written as Spark DataFrame and Spark ML jobs."""
