"""tarnflow: river-network and water-quality analytics on PySpark."""
