"""Thresholds of the classifiers and their labels.

Fixed values: labels and defaults have to equal those of existing data and consumers.
"""

from __future__ import annotations

from dataclasses import dataclass

EMERGING, ACTIVE, STABLE, DECLINING, ABANDONED, WATCHED = "新兴技能", "活跃技能", "稳定核心技能", "衰退技能", "废弃技能", "观察中"
ADDED, REMOVED, UP, DOWN = "新增技能", "消失技能", "频率上升技能", "频率下降技能"
ACTIVE_NOW, ABSENT = "当月活跃技能", "当月未出现"
EMERGING_TYPES, DECLINING_TYPES = (ADDED, UP), (REMOVED, DOWN)


@dataclass(frozen=True)
class Abandoned:
    """Not seen for so many months, after so many mentions in all."""

    silent_months: int = 4
    mentions: int = 3


@dataclass(frozen=True)
class Declining:
    """Fewer than a share of the mentions of the three months before, which were enough to tell, and rare now."""

    before: int = 3
    share_left: float = 0.5
    frequency: float = 0.05


@dataclass(frozen=True)
class Emerging:
    """Young, with so many mentions in three months."""

    age: int = 3
    recent: int = 2


@dataclass(frozen=True)
class Growing:
    """Not old, with so many mentions in three months, and so much more than in the three before."""

    age: int = 6
    recent: int = 3
    rise: float = 0.5


@dataclass(frozen=True)
class Stable:
    """Old, active in so many of six months, frequent in all and now, and even."""

    age: int = 6
    active_months: int = 4
    cumulative: float = 0.25
    frequency: float = 0.15
    deviation: float = 0.25


@dataclass(frozen=True)
class Sparse:
    """Stable in a job of few postings: old, with mentions, and in most of the postings."""

    mentions: int = 5
    cumulative: float = 0.5
    frequency: float = 0.5
    recent: int = 1


@dataclass(frozen=True)
class Active:
    """Active in so many of three months and frequent, or mentioned so often in three months."""

    months: int = 2
    frequency: float = 0.08
    recent: int = 3


@dataclass(frozen=True)
class LifecycleRules:
    abandoned: Abandoned = Abandoned()
    declining: Declining = Declining()
    emerging: Emerging = Emerging()
    growing: Growing = Growing()
    stable: Stable = Stable()
    sparse: Sparse = Sparse()
    active: Active = Active()


@dataclass(frozen=True)
class AnnualRules:
    stable_cycles: int = 2
    stable_cumulative: float = 0.25
    silent_cycles: int = 2
    abandoned_mentions: int = 3


@dataclass(frozen=True)
class ProfileRules:
    core_min_monthly_count: int = 1
    core_frequency: float = 0.25
    stable_core_delta: float = 0.05
    change_delta: float = 0.08


@dataclass(frozen=True)
class RouteRules:
    category_floor: float = 0.58
    category_gap: float = 0.03
    max_categories: int = 3
    job_floor: float = 0.58
    direct_score: float = 0.82
    direct_margin: float = 0.03
    judged_score: float = 0.75
    judged_confidence: float = 0.80
    judged_max_rank: int = 1


@dataclass(frozen=True)
class SeedRules:
    title_weight: int = 6
    responsibility_weight: int = 5
    requirement_weight: int = 1
    close_margin: int = 1
