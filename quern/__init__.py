"""quern: a typed selection engine and data toolkit on PySpark DataFrames."""
