"""Training-data operators: ten independent Spark jobs over text tables.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the folder is present.
"""
