"""textguard: a Spark-native engine for finding and replacing personal data in text."""
