"""framewell: media-collection analytics expressed as Spark DataFrame programs."""
