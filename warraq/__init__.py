"""Spark-native Arabic text diagnostics and corpus analytics."""
