"""shareflow: shareholding analytics and corpus preparation as plain Spark DataFrame functions."""
