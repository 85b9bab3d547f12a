"""Radio-telemetry and other detection tracks, as PySpark DataFrame operators."""
