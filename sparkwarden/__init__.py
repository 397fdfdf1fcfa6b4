"""Software-assurance graph analytics as Spark jobs."""
