"""Mining: rules, profiles, clusters, classifiers, forecasts, anomalies."""
