"""Checks of generation and evaluation settings, given as nested mappings (as a YAML or JSON file holds them)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

MODES = ("pilot_mix", "drone_positive_synthetic", "smoke_manual")
SAMPLING = ("random", "balanced_marginals")
SOURCES = ("raw", "processed")
BACKGROUNDS = ("uniform_by_file", "balanced_by_type")
#: Counts of a pinned schedule, with the subset and the distractor that each stands for.
PINNED = {
    "synthetic_drone_positive": ("synthetic_drone_positive", None),
    "synthetic_distractor_only_bird": ("synthetic_distractor_only", "bird"),
    "synthetic_distractor_only_airplane": ("synthetic_distractor_only", "airplane"),
    "synthetic_drone_plus_distractor_bird": ("synthetic_drone_plus_distractor", "bird"),
    "synthetic_drone_plus_distractor_airplane": ("synthetic_drone_plus_distractor", "airplane"),
}


def read(path: str) -> dict[str, Any]:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed; give the settings as JSON") from e
        return yaml.safe_load(f)


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    word = str(value).lower()
    if word not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return word


@dataclass(frozen=True)
class Placement:
    mode: str = "upper_sky"
    across: tuple[float, float] = (0.05, 0.95)
    down: tuple[float, float] = (0.03, 0.55)
    attempts: int = 50
    avoid_overlap: bool = True
    max_iou: float = 0.05
    least_distance: int = 20
    margin: int = 8
    sky_share: float = 0.75


@dataclass(frozen=True)
class Generation:
    mode: str
    images: int
    sampling: str
    source: str
    backgrounds: str
    ratios: dict[str, float]
    schedule: tuple[tuple[str, str | None], ...]
    sizes: tuple[int, ...]
    variables: dict[str, list]
    excluded_labels: frozenset[str]
    accept_only: bool
    seed: int
    placement: Placement = field(default_factory=Placement)


def generation(raw: dict[str, Any]) -> Generation:
    """Checked generation settings; wrong words, shares that do not add up to 1 and empty schedules raise."""
    gen, inputs, variables = raw.get("generation", {}), raw["input"], raw["variables"]
    mode = _one_of("generation.mode", gen.get("mode", "pilot_mix"), MODES)
    schedule: list[tuple[str, str | None]] = []
    ratios: dict[str, float] = {}
    if mode == "drone_positive_synthetic":
        ratios = {"drone_positive_synthetic": 1.0}
    elif mode == "smoke_manual":
        counts = gen.get("subset_counts", {})
        schedule = [what for name, what in PINNED.items() for _ in range(int(counts.get(name, 0)))]
        if not schedule:
            raise ValueError("smoke_manual needs generation.subset_counts")
    else:
        ratios = {k: float(v) for k, v in gen["subset_ratios"].items()}
        if abs(sum(ratios.values()) - 1) > 1e-6:
            raise ValueError(f"subset_ratios add up to {sum(ratios.values())}, not 1")
    sizes = variables.get("object_size_px", variables.get("drone_size_px"))
    if sizes is None:
        raise ValueError("variables needs object_size_px or drone_size_px")
    paste, place = raw.get("paste", {}), raw.get("placement")
    margin, share = int(paste.get("margin_px", 8)), float(paste.get("sky_region_top_fraction", 0.75))
    if place:
        default = Placement()
        placement = Placement(
            str(place.get("mode", default.mode)),
            (float(place.get("x_min_fraction", default.across[0])), float(place.get("x_max_fraction", default.across[1]))),
            (float(place.get("y_min_fraction", default.down[0])), float(place.get("y_max_fraction", default.down[1]))),
            int(place.get("max_attempts", default.attempts)),
            bool(place.get("avoid_overlap", default.avoid_overlap)),
            float(place.get("max_iou", default.max_iou)),
            int(place.get("min_object_distance_px", default.least_distance)),
            int(place.get("margin_px", margin)),
            share,
        )
    else:
        placement = Placement(mode="legacy", margin=margin, sky_share=share)
    return Generation(
        mode=mode,
        images=len(schedule) if mode == "smoke_manual" else int(gen["num_images"]),
        sampling=_one_of("generation.variable_sampling", gen.get("variable_sampling", "random"), SAMPLING),
        source=_one_of("input.asset_source", inputs.get("asset_source", "processed"), SOURCES),
        backgrounds=_one_of("generation.background_sampling", gen.get("background_sampling", "uniform_by_file"), BACKGROUNDS),
        ratios=ratios,
        schedule=tuple(schedule),
        sizes=tuple(int(x) for x in sizes),
        variables={k: list(v) for k, v in variables.items() if isinstance(v, list)},
        excluded_labels=frozenset(str(x).lower() for x in inputs.get("exclude_quality_labels", ["reject"])),
        accept_only=bool(inputs.get("require_accept_label", False)),
        seed=int(raw.get("seed", 42)),
        placement=placement,
    )


@dataclass(frozen=True)
class Evaluation:
    thresholds: tuple[float, ...]
    confidences: tuple[float, ...]
    primary: float
    classes: tuple[str, ...]
    models: tuple[dict[str, Any], ...]


def evaluation(raw: dict[str, Any]) -> Evaluation:
    """Checked evaluation settings: enabled models with their defaults, thresholds between 0 and 1."""
    ev, shared = raw["evaluation"], raw.get("grounding_dino") or {}
    models = []
    for m in raw.get("models", []):
        one = {"confidence": 0.05, "enabled": True, "box_threshold": 0.20, "text_threshold": 0.20, "prompts": []}
        one |= (shared if m.get("type") == "grounding_dino" else {}) | m
        if not one.get("name") or not one.get("type"):
            raise ValueError("a model needs a name and a type")
        if one["enabled"]:
            models.append(one)
    thresholds = tuple(float(x) for x in ev.get("iou_thresholds", [0.25, 0.5]))
    confidences = tuple(float(x) for x in ev.get("confidence_thresholds", [0.05]))
    if not thresholds or any(not 0 <= x <= 1 for x in (*thresholds, *confidences)):
        raise ValueError("thresholds must lie between 0 and 1")
    return Evaluation(thresholds, confidences, float(ev.get("primary_iou_threshold", 0.5)), tuple(str(c) for c in ev.get("drone_like_classes", ["drone"])), tuple(models))


def run_info(settings: dict[str, Any], **facts: Any) -> str:
    """Settings and facts of a run as JSON text, keys in order."""
    return json.dumps({"settings": settings, **facts}, indent=2, sort_keys=True, default=str)
