"""Code-review analytics on Spark: users, repositories, reviews, issues, comments, source files, diffs and commits."""
