"""Document and media preparation engine on Spark: every operator is DataFrame -> DataFrame or Column -> Column."""
