"""hirelake: job-posting analytics on Spark."""
