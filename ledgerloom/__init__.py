"""ledgerloom: document question-answering analytics as PySpark DataFrame transformations."""
