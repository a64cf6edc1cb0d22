"""contractlens: rule-driven contract analytics on PySpark DataFrames."""
