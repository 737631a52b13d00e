"""beatframe: keyed sensor-frame analytics as plain PySpark DataFrame operators."""
