"""Thresholds of the cascade and the sizes that steer physical choices."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values of the classification rules.
    rate_limit: int = 60
    bot_score: int = 70
    similarity: float = 0.92
    low_confidence: tuple[float, float] = (0.4, 0.6)
    reputation_ttl_ms: int = 3_600_000
    rate_window_ttl_ms: int = 120_000

    # A (ip, minute) group larger than this is split before it is ranked.
    hot_rows: int = 1_000_000
    # Key lists are broadcast only up to this many rows.
    broadcast_keys: int = 100_000
    # Fingerprints are broadcast only up to this many vector elements (64 MB as doubles).
    broadcast_elements: int = 8_000_000
    # Vectors that one search task holds at once, beyond the broadcast size.
    vectors_per_shard: int = 20_000
    queries_per_shard: int = 50_000
    # Cells the fingerprint space is divided into, beyond the broadcast size.
    pivots: int = 512
    # A client's entry is kept for this long after it has expired, for requests that arrive late.
    most_late_ms: int = 86_400_000
    # Batches between two snapshots of the clients' entries.
    snapshot_every: int = 20


DEFAULTS = Settings()

# The only verdict classes and sources.
CLASSES = ("LEGITIMATE", "SUSPICIOUS", "BOT")
SOURCES = ("CACHE", "HEURISTIC", "AI", "VECTOR")
