"""Engine settings; only keys that a computation reads."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are fixed values of the data model."""

    max_context_tokens: int = 120_000
    soft_token_threshold: int = 100_000
    hard_token_threshold: int = 150_000
    fresh_tail_size: int = 64
    leaf_summary_budget: int = 1_200
    condensed_summary_budget: int = 2_000
    max_summary_depth: int = 5
    aggressive_threshold: int = 3
    large_file_threshold: int = 50_000
    summarize_after_messages: int = 20
    summarize_after_tokens: int = 20_000
    min_condense: int = 5

    def __post_init__(self) -> None:
        bad = [k for k, v in vars(self).items() if not isinstance(v, (int, float)) or isinstance(v, bool) or not 0 < v < float("inf")]
        if bad:
            raise ValueError(f"settings must be finite and above 0: {', '.join(bad)}")

    def thresholds(self) -> tuple[int, int]:
        """Effective (soft, hard) token thresholds."""
        most = self.max_context_tokens
        soft = max(1, int(0.7 * most))
        hard = max(soft, int(0.9 * most))
        base = self.soft_token_threshold if 0 < self.soft_token_threshold < most else soft
        soft = min(base, max(1, 4 * self.leaf_summary_budget))
        if soft < self.hard_token_threshold <= most:
            hard = self.hard_token_threshold
        return soft, hard
