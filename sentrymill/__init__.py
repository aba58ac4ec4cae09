"""Event analytics and anomaly detection as PySpark DataFrame operators."""
