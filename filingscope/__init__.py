"""Filing-text signals as Spark DataFrame jobs."""
