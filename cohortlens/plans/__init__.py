"""Plan-level building blocks: skew handling, size-checked lookups, ordered scans."""
