"""Settings of the jobs, with the defaults a plain run uses."""

from __future__ import annotations

from dataclasses import dataclass, field

# The settings a run without configuration must use.
MIN_INTERACTIONS = 10
SPLIT_WEIGHTS = (0.6, 0.2, 0.2)
SEED = 1
MIN_RELEVANT_RATING = 3
TOP_K = 500
GRID_RANKS = (10, 20, 40, 80, 160)
GRID_REG_PARAMS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
ALS_MAX_ITER = 10
ALS_MIN_BLOCKS = 10
ALS_CHECKPOINT_INTERVAL = 10
VIEW_LIMIT = 25.0

# What one task may hold comfortably; these steer the layout, never the result.
ROWS_PER_TASK = 1_000_000
MAX_HEAVY_KEYS = 100_000


@dataclass(frozen=True)
class SkewConfig:
    """When a key counts as heavy.

    Heavy keys are the keys with more than ``rows_per_task`` rows, at most
    ``max_keys`` of them, the largest first. The list has a fixed bound, so it may be
    broadcast; a key that finds no place in it holds less than ``1 / max_keys`` of
    all rows.
    """

    rows_per_task: int = ROWS_PER_TASK
    max_keys: int = MAX_HEAVY_KEYS

    def __post_init__(self) -> None:
        if self.rows_per_task < 1 or self.max_keys < 1:
            raise ValueError("rows_per_task and max_keys must be positive")


@dataclass(frozen=True)
class SplitConfig:
    """Settings of the train / validation / test split."""

    min_interactions: int = MIN_INTERACTIONS
    percent: float = 100
    weights: tuple[float, float, float] = SPLIT_WEIGHTS
    sample_seed: int = SEED
    split_seed: int = SEED
    shuffle_seed: int = SEED
    # Columns that identify a row. Without them identical rows count as copies.
    row_key: tuple[str, ...] | None = None
    skew: SkewConfig = field(default_factory=SkewConfig)


@dataclass(frozen=True)
class AlsConfig:
    """Settings of one ALS fit; ``blocks=None`` follows the cluster size."""

    rank: int = GRID_RANKS[0]
    reg_param: float = 0.1
    max_iter: int = ALS_MAX_ITER
    blocks: int | None = None
    seed: int = SEED
    checkpoint_interval: int = ALS_CHECKPOINT_INTERVAL
    storage_level: str = "MEMORY_AND_DISK"


@dataclass(frozen=True)
class EvalConfig:
    """How a model is scored."""

    mode: str = "test_rows"
    k: int = TOP_K
    min_rating: int = MIN_RELEVANT_RATING
    # "rank" keeps every row tied with the k-th, "row_number" exactly k rows.
    ties: str = "rank"
    # True counts a repeated (user, item) prediction once.
    dedup: bool = False


@dataclass(frozen=True)
class GridConfig:
    """The grid of fits; ranks are the outer loop."""

    ranks: tuple[int, ...] = GRID_RANKS
    reg_params: tuple[float, ...] = GRID_REG_PARAMS
    parallel_fits: int = 1
    als: AlsConfig = field(default_factory=AlsConfig)

    def points(self) -> list[tuple[int, float]]:
        return [(rank, reg) for rank in self.ranks for reg in self.reg_params]


@dataclass(frozen=True)
class ViewConfig:
    """Settings of the sampled two-dimensional view.

    A percentage of 0 means "keep every row once".
    """

    train_percent: float = 5
    plot_percent: float = 100
    balance: bool = True
    seed: int = SEED
    limit: float = VIEW_LIMIT
