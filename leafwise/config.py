"""Router configuration: models by tier and a few knobs, read from JSON and validated on the driver."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import numpy as np

# Tiers, document types, reasons and defaults that results must agree with.
TIERS = ("local", "standard", "premium")
PDF_TYPES = ("text_based", "scanned", "image_based", "mixed", "unknown")
PLAN_REASONS = ("low_confidence", "text_layer", "scanned", "mixed_split", "mixed_unsplit")
BYPASS_REASONS = ("not_pdf", "oversize", "image", "classifier_unavailable")
JUDGES = ("heuristic", "jev", "jev_gated")
FAILURES = {"timeout": "jev_fallback_timeout", "http": "jev_fallback_http", "protocol": "jev_fallback_protocol", "breaker_open": "jev_fallback_breaker_open"}
GATED_REASON, ASKED_NEEDS, ASKED_CLEAR = "jev_not_escalated", "jev_needs_ocr", "jev_clear"
MIN_CONFIDENCE, MAX_DOCUMENT_BYTES, FETCH_TIMEOUT_SECONDS = 0.6, 50 * 1024 * 1024, 20.0
LOCAL_MODEL, STANDARD_MODEL = "local_pdf/extract", "mistral-ocr"
LEG_FAILED, BYPASS_TIER = "leg_failed", "bypass"
# End of fixed values.


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Models:
    local: str = LOCAL_MODEL
    standard: str = STANDARD_MODEL
    premium: str | None = None


@dataclass(frozen=True)
class Config:
    tiers: Models = field(default_factory=Models)
    min_confidence: float = MIN_CONFIDENCE
    complex_layout_tier: str = "premium"
    max_document_bytes: int = MAX_DOCUMENT_BYTES
    fetch_timeout_seconds: float = FETCH_TIMEOUT_SECONDS
    split_pages: bool = True

    def model_for(self, tier: str) -> str:
        """The model of a tier; a tier without one is an error."""
        model = getattr(self.tiers, tier, None)
        if model is None:
            raise ConfigError(f"tier {tier} has no model")
        return model

    def complex_tier(self) -> str:
        """The tier for complex layouts, standard if it asks for a premium model that isn't there."""
        return "standard" if self.complex_layout_tier == "premium" and self.tiers.premium is None else self.complex_layout_tier

    def validated(self) -> Config:
        for tier in TIERS:
            model = getattr(self.tiers, tier)
            if (model is None and tier != "premium") or (model is not None and not str(model).strip()):
                raise ConfigError(f"tiers.{tier} is blank")
        if self.complex_layout_tier not in ("standard", "premium"):
            raise ConfigError("complex_layout_tier must be standard or premium")
        if not (math.isfinite(self.min_confidence) and 0 <= self.min_confidence <= 1):
            raise ConfigError("min_confidence must be from 0 to 1")
        if self.max_document_bytes <= 0:
            raise ConfigError("max_document_bytes must be above 0")
        if not (math.isfinite(self.fetch_timeout_seconds) and self.fetch_timeout_seconds > 0):
            raise ConfigError("fetch_timeout_seconds must be above 0")
        return self

    @property
    def min_confidence_32(self) -> float:
        """The threshold as a 32-bit float, which is what confidences are compared with."""
        return float(np.float32(self.min_confidence))

    def as_dict(self) -> dict:
        return asdict(self)


def _known(kind: type, values: dict, where: str) -> dict:
    extra = set(values) - {f.name for f in fields(kind)}
    if extra:
        raise ConfigError(f"unknown keys in {where}: {', '.join(sorted(extra))}")
    return values


def from_dict(values: dict) -> Config:
    values = dict(_known(Config, values, "the configuration"))
    if "tiers" in values:
        values["tiers"] = Models(**_known(Models, values["tiers"], "tiers"))
    return Config(**values).validated()


def from_json(text: str) -> Config:
    try:
        values = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"the configuration is no JSON: {e}") from e
    if not isinstance(values, dict):
        raise ConfigError("the configuration is no JSON object")
    return from_dict(values)


def load(path: str | None = None) -> Config:
    """Defaults without a path; what can't be read and what can't be parsed are told apart."""
    if path is None:
        return Config()
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    return from_json(text)


def defaults() -> dict:
    return Config().as_dict()


#: The five variants that plans are recorded for.
VARIANTS = {
    "premium": Config(Models(premium="premium-ocr")),
    "no_premium": Config(),
    "no_split": Config(Models(premium="premium-ocr"), split_pages=False),
    "strict": Config(Models(premium="premium-ocr"), min_confidence=1.0),
    "complex_standard": Config(Models(premium="premium-ocr"), complex_layout_tier="standard"),
}
