"""Explicit schemas of the landed tables."""

DETECTIONS = "latitude double, longitude double, bright_ti4 double, scan double, track double, acq_date date, acq_time int, confidence string, frp double, daynight string"
WEATHER = "station string, date date, temp_c double, rh_pct double, wind_kmh double, precip_mm double"
POLYGON = "struct<type: string, coordinates: array<array<array<double>>>>"
FEATURES = f"struct<type: string, features: array<struct<type: string, properties: map<string, string>, geometry: {POLYGON}>>>"
