"""Trade-and-quote analytics as plain DataFrame -> DataFrame functions on Spark."""
