"""verishelf: a Spark-native engine that turns messy product records into validated rows."""
