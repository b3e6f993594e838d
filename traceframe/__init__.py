"""Evidence tracing over document collections, as Spark DataFrame functions."""
