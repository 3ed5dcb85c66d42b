"""noticeworks: Spark-native processing of public-notice and job-posting data."""
