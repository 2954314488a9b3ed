"""pitrank: point-in-time, cross-sectional ranking analytics on PySpark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
loops over days or tickers: time series work is expressed as windows over one
shuffle by ``ticker`` and cross sections as windows (or salted ranks) by
``trade_date``.
"""

__version__ = "0.1.0"
