"""Spark-native table migration, change-log apply and reconciliation."""
