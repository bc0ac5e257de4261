"""gradelake: Spark jobs for document admission, assessment scoring and evaluation."""
