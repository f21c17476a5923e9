"""Scalar functions over dates, URLs, text, HTML and bytes."""
