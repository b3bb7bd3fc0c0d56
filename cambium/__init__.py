"""cambium: wood-anatomy analytics and corpus preparation as Spark jobs."""
