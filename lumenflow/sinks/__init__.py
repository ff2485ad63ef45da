"""Writers: detection text, track CSV, alignment profile, prepared tables."""
