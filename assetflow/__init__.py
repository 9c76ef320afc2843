"""assetflow: image-library bookkeeping as Spark DataFrame, SQL and streaming jobs."""
