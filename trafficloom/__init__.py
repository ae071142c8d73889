"""Network-traffic fingerprinting and training-data operators on PySpark."""
