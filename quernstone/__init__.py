"""quernstone: event analytics and corpus preparation on PySpark."""
