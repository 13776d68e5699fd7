"""Spark-native analytics for job-application tracking and vacancy discovery."""
