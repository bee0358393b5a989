"""storyloom: catalog and content analytics expressed as Spark DataFrame plans."""
