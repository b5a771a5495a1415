"""haplospan: pangenome graph analytics expressed as Spark DataFrame plans."""
