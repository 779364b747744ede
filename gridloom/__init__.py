"""gridloom: Spark-native analytics over tile grids, pixels, codecs and packs."""
