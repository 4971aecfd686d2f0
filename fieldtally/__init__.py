"""fieldtally: wildlife field-survey analytics expressed as Spark DataFrame jobs."""
