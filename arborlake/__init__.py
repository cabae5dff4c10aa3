"""arborlake: metadata change logs, file-tree state and provenance graphs on Spark."""
