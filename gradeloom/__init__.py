"""gradeloom: assessment analytics expressed as Spark DataFrame plans."""
