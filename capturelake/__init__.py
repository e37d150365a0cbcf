"""capturelake: Spark-native analytics over fleets of database incident captures."""
