"""Spark-native analytics over tracked movement and behavioural sequences."""
