"""Culture biomass analytics as Spark DataFrame jobs."""
