"""demandsense - demand-sensing operators for PySpark.

Every public operator takes DataFrames and plain parameters and returns a
DataFrame.  Nothing here collects data rows to the driver; the few driver-side
reads are one-row scalars (first and last day, model coefficients, a solve whose
size is the number of backtest cases).
"""
