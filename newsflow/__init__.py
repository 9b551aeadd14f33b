"""newsflow: financial-news text analytics as PySpark DataFrame jobs."""
