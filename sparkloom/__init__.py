"""Code and text intelligence on Spark: corpus tables, search, graphs, modules and change tracking as DataFrame operators."""
