"""tessera: snapshot analytics and corpus preparation as Spark DataFrame jobs."""
