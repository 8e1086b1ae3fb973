"""Parameters of the engine; one frozen record for a run."""

from dataclasses import dataclass

MODES = ("se", "pe", "se_ord", "pe_ord", "min_pe")


@dataclass(frozen=True)
class EngineParams:
    err: float = 0.12
    suffix_mode: bool = True
    separate_n: bool = True
    ov: float = 0.65
    seed: int = 38
    pre_seed: int = 0
    min_chars_per_mismatch: int = 3
    min_repeat: int = 45
    mode: str = "se"
    rc_mate2: bool = True
    min_overlap: int | None = None
    bucket_cap: int | None = None
    keep_stages: bool = False

    def __post_init__(self) -> None:
        checks = {
            "err is in (0, 1]": 0 < self.err <= 1,
            "ov is in [0, 1]": 0 <= self.ov <= 1,
            "seed is at least 20": self.seed >= 20,
            "min_chars_per_mismatch is at least 2": self.min_chars_per_mismatch >= 2,
            "min_repeat is at least 20": self.min_repeat >= 20,
            f"mode is one of {MODES}": self.mode in MODES,
        }
        if broken := [k for k, ok in checks.items() if not ok]:
            raise ValueError("; ".join(broken))
