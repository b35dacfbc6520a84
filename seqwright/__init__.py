"""seqwright: text annotation and statistical sequence analytics on PySpark."""
