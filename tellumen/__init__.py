"""tellumen: fleet-reliability analytics expressed as Spark plans."""
