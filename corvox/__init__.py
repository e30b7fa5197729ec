"""Spark-native analytics over procedural-imaging and robot-learning corpora."""
