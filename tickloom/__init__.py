"""Spark-native market analytics: bars, alignment, backtests, splits and streaming."""
