"""lodestone: evidence retrieval and knowledge accumulation over text, as Spark DataFrame transformations."""
