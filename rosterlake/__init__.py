"""Spark-native building, checking and completing of tables of people at scale."""
