"""siftline: document search analytics as Spark DataFrame plans."""
