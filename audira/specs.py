"""Parameter objects. They hold the words of the data, so that operators stay neutral."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ViewRouting:
    """How view rows are split by title type; only the local-title rows of one channel are restricted."""

    metric: str = "조회수"
    local_title: str = "한글제목"
    foreign_title: str = "영어제목"
    restricted_media: str = "유튜브"
    allowed_attr1: tuple[str, ...] = ("PGC", "UGC")


@dataclass(frozen=True)
class MetricSpec:
    """One KPI: which rows, how they roll up, where peers are cut and which direction is good.

    mode: ``mean`` (mean per step, then mean), ``step_sum`` (sum per step, then mean), ``sum``, ``min``,
    ``vod`` (sum of both media on steps where the first has data, then mean) or ``flat_mean``. A ``normalized``
    metric name ignores case and punctuation. ``group_mode`` tells how a group's value follows at a cutoff: the mean of its
    ``entities``' values, or the KPI over all ``rows`` of the group.
    """

    kpi: str
    metric: str
    mode: str = "mean"
    media: tuple[str, ...] | None = None
    views: str | None = None
    cutoff: str = "step"
    high_is_good: bool = True
    keep_zero: bool = False
    normalized: bool = False
    group_mode: str = "entities"


# The KPI catalogue of the detail page.
DETAIL_KPIS = (
    MetricSpec("target_rating", "T시청률"),
    MetricSpec("household_rating", "H시청률"),
    MetricSpec("live_uv", "시청인구", "step_sum", ("TVING LIVE",)),
    MetricSpec("quick_uv", "시청인구", "step_sum", ("TVING QUICK",)),
    MetricSpec("vod_uv", "시청인구", "vod", ("TVING VOD", "TVING QUICK")),
    MetricSpec("other_platform", "시청자수", "step_sum", ("웨이브",)),
    MetricSpec("external_rank", "N_W순위", "min", cutoff="week", high_is_good=False, normalized=True),
    MetricSpec("mentions", "언급량", "sum", cutoff="week"),
    MetricSpec("views_total", "조회수", "sum", views="total", cutoff="week"),
    MetricSpec("views_foreign", "조회수", "sum", views="foreign", cutoff="week"),
    MetricSpec("buzz_rank", "F_Total", "min", cutoff="week", high_is_good=False, normalized=True),
    MetricSpec("buzz_score", "F_score", cutoff="week", keep_zero=True, normalized=True, group_mode="rows"),
)
# The columns of the overview table; its buzz score sums the rows of a step.
OVERVIEW_KPIS = (
    MetricSpec("target_rating", "T시청률"),
    MetricSpec("household_rating", "H시청률"),
    MetricSpec("live_uv", "시청인구", "step_sum", ("TVING LIVE",)),
    MetricSpec("quick_uv", "시청인구", "step_sum", ("TVING QUICK",)),
    MetricSpec("vod_uv", "시청인구", "step_sum", ("TVING VOD",)),
    MetricSpec("mentions", "언급량", "sum"),
    MetricSpec("views", "조회수", "sum", views="total"),
    MetricSpec("buzz_rank", "F_Total", "min", keep_zero=True),
    MetricSpec("buzz_score", "F_Score", "step_sum"),
)
# The seven KPIs of the comparison page.
COMPARISON_KPIS = (
    MetricSpec("target_rating", "T시청률"),
    MetricSpec("household_rating", "H시청률"),
    MetricSpec("vod_uv", "시청인구", "vod", ("TVING VOD", "TVING QUICK")),
    MetricSpec("live_uv", "시청인구", "step_sum", ("TVING LIVE",)),
    MetricSpec("views", "조회수", "sum", views="total"),
    MetricSpec("mentions", "언급량", "sum"),
    MetricSpec("buzz_score", "F_Score"),
)


@dataclass(frozen=True)
class AnchorRule:
    """Least mean rating per slot, before and from a year on."""

    last_old_year: int = 2025
    old: dict[str, float] = field(default_factory=lambda: {"토일": 3.0, "월화": 2.0})
    new: dict[str, float] = field(default_factory=lambda: {"토일": 2.5, "월화": 1.5})
    # Titles that are never counted.
    excluded: tuple = ()


@dataclass(frozen=True)
class PersonWeights:
    burst: float = 0.4
    stability: float = 0.3
    contribution: float = 0.3


# Week labels before launch, in order, and two after it.
PRELAUNCH_WEEKS = ("W-6", "W-5", "W-4", "W-3", "W-2", "W-1")
LAUNCH_WEEKS = ("W+1", "W1", "W 1", "W+01")
# Growth cutoffs and the factor for titles that also run on another platform.
GROWTH_CUTOFFS = (2, 4, 6, 8, 10, 12, 14, 16)
PLATFORM_FACTOR = 1.4


@dataclass(frozen=True)
class GrowthSpec:
    """One growth metric: rows, and whether steps are summed or averaged."""

    name: str
    metric: str
    mode: str = "mean"
    media: tuple[str, ...] | None = None
    views: str | None = None
    flag_factor: float | None = None


GROWTH_BROADCAST = (
    GrowthSpec("household_rating", "H시청률"),
    GrowthSpec("target_rating", "T시청률"),
    GrowthSpec("live", "시청인구", "sum", ("TVING LIVE",)),
    GrowthSpec("vod", "시청인구", "sum", ("TVING VOD",), flag_factor=PLATFORM_FACTOR),
)
GROWTH_DIGITAL = (
    GrowthSpec("views", "조회수", "sum", views="total"),
    GrowthSpec("buzz", "F_Score"),
)
