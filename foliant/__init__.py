"""Search and analytics over large document libraries, as PySpark DataFrame operators."""
