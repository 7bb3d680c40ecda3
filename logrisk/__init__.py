"""logrisk: failure-risk analytics for batch jobs, written as Spark jobs."""
