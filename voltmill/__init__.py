"""Half-hourly metering telemetry and training-data operators, declared on the DataFrame API."""
