"""Readers: binary recordings, inertial CSV, calibration, table bridges."""
