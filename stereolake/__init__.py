"""stereolake: multi-camera motion-capture analytics as Spark DataFrame jobs."""
