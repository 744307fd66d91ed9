"""weftline: road-network signal analytics expressed as Spark DataFrame plans."""
