"""Spark-native page, prompt and copy processing for collection-page writing."""
