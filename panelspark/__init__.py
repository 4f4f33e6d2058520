"""panelspark: entity x period panels, spatial statistics and forecasts on Spark DataFrames."""
