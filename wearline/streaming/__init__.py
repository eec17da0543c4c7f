"""Structured Streaming jobs: live scoring (R1), windowed OEE (R2), wear with reset (R3),
last-N readings (R4) and windowed drift against a frozen reference (R5)."""
