"""mnemospark: memory analytics as DataFrame -> DataFrame operators on Spark."""
