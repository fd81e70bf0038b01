"""Signal analytics over daily price bars, expressed as Spark plans."""
