"""graphloom: graph analytics as Spark DataFrame plans."""
