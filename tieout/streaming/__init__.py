"""Intentionally empty.

The reference has no stream source, watermark, window, state or late-data
rebuild. Batch readers in ``tieout.sources`` cover every input it accepts.
"""
