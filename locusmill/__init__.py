"""Association analysis of cohorts and variants, and corpus preparation, as Spark jobs."""
