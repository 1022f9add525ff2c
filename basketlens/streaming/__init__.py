"""Streaming use of the row-wise operators.

The analysed work is batch only (no watermark, window or state). The
row-wise classifiers (page class, path name, platform, time bound) apply
unchanged to a streaming DataFrame; this module wires them to a file
stream so new event files are classified as they land."""
