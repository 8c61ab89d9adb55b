"""Sources beyond Parquet: day-named log files and chat recordings in XML."""
