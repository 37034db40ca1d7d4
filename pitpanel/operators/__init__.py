"""Panel operators: functions from DataFrame to DataFrame with explicit key columns."""
