"""quillspark: assessment analytics and corpus preparation expressed in PySpark."""
