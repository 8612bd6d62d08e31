"""Analytics on annotated multichannel recordings, expressed as Spark DataFrame jobs."""
