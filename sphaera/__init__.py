"""Spark-native analytics over triangle meshes and their sphere approximations."""
