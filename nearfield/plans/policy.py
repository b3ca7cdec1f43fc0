"""Detection policy as data: thresholds, weights and gates, with the defaults of both levels."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Threshold:
    """One level (confirmed or suspicious) of a policy."""

    score: float = 63.0
    phash_max: int = 16
    dhash_max: int = 12
    total_max: int = 26
    near_miss_slack: int = 0
    perceptual_weight: float = 1.8
    anchor_weight: float = 2.2
    dense_weight: float = 1.4
    perceptual_floor: float = 35.0
    full_hits: int = 500
    full_regions: int = 14
    full_spread: float = 700.0
    min_hits: int = 80
    min_regions: int = 10
    max_mean_distance: float = 7.0
    luma_delta: int = 55
    contrast_delta: int = 50
    edge_delta: int = 55
    position_delta: int = 100
    min_short_edge: int = 640
    min_area: int = 350_000
    max_aspect: float = 1.4
    aspect_delta: float = 0.45
    width_delta: float = 0.30
    height_delta: float = 0.30
    visual_weight: float = 0.0
    affine_extra_hits: int = 1
    affine_extra_regions: int = 0
    affine_residual: float = 22.0
    homography_extra_hits: int = 2
    homography_extra_regions: int = 1
    homography_residual: float = 18.0
    support_hits: int = 50
    support_regions: int = 25
    support_permille: int = 200
    support_mean: float = 11.75
    support_total: int = 51
    support_aspect: float = 0.45
    support_dimension: float = 0.55


@dataclass(frozen=True)
class Shape:
    """Looks of the images in question: dark, of little colour, with text in the middle."""

    min_luma: int = 30
    max_luma: int = 92
    min_std: int = 50
    max_std: int = 80
    min_text: int = 24
    max_text: int = 170
    min_regions: int = 34
    min_middle: int = 35
    min_center: int = 0
    max_center: int = 78
    max_edge: int = 46
    max_rgb_spread: int = 34
    min_local: int = 180
    min_signals: int = 4
    sparse_luma: int = 35
    sparse_text: int = 110
    sparse_local: int = 80
    weight: float = 1.0
    cap: float = 10.0
    full: float = 300.0


SUSPICIOUS = Threshold(score=20.0, dhash_max=15, total_max=30, near_miss_slack=6, min_hits=20, max_mean_distance=12.0, luma_delta=70, contrast_delta=65, edge_delta=75, position_delta=120, max_aspect=1.36, aspect_delta=0.35, width_delta=0.20, height_delta=0.20)


@dataclass(frozen=True)
class TextGate:
    enabled: bool = False
    keywords: tuple[str, ...] = ()
    sentences: tuple[str, ...] = ()
    keyword_threshold: int = 2
    keyword_max_distance: int = 1
    sentence_max_distance: int = 2


@dataclass(frozen=True)
class Policy:
    confirmed: Threshold = field(default_factory=Threshold)
    suspicious: Threshold = SUSPICIOUS
    gate: TextGate = field(default_factory=TextGate)
    cluster_member: int = 25
    cluster_coherence: int = 63
    cluster_min_size: int = 2
    cluster_hard: int = 63
    shape: Shape = field(default_factory=Shape)

    def problems(self) -> list[str]:
        """What a configuration check would refuse."""
        out = []
        for name, t in (("confirmed", self.confirmed), ("suspicious", self.suspicious)):
            if not 0 <= t.phash_max <= 64 or not 0 <= t.dhash_max <= 64:
                out.append(f"{name}: hash distances lie between 0 and 64")
            if t.total_max > t.phash_max + t.dhash_max:
                out.append(f"{name}: the total is beyond what both distances allow")
            if t.max_aspect < 1 or t.score < 0:
                out.append(f"{name}: aspect is at least 1 and score at least 0")
        if self.suspicious.score > self.confirmed.score:
            out.append("the suspicious score exceeds the confirmed one")
        return out


#: Wider limits for the driver's vectors, in which hardly any pair is as close as real copies are.
WIDE = Policy(confirmed=replace(Threshold(), phash_max=24, dhash_max=24, total_max=46), suspicious=replace(SUSPICIOUS, phash_max=27, dhash_max=27, total_max=50, near_miss_slack=2, score=20.0))


def as_rows(spark: SparkSession, thresholds: dict[str, Threshold]) -> DataFrame:
    """A table of thresholds, one row each, to be cross-joined with candidate pairs."""
    return spark.createDataFrame([{"policy": k} | asdict(t) for k, t in thresholds.items()])
