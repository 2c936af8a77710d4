"""Training preparation as one fit/transform pair, shared by training and serving."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.fixed_values import REFERENCE_DATE
from .align import fill_family, numeric_columns
from .encode import (
    add_date_features, apply_one_hot, apply_scaler, apply_target_encoder, fit_one_hot, fit_scaler, fit_target_encoder,
)


@dataclass
class Preparation:
    """Everything learned from the training rows."""

    target: str
    date: str
    founded: str
    t0: str
    family_marker: str
    family_fill: float
    target_encoders: dict[str, tuple[DataFrame, dict]] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)

    def encode(self, df: DataFrame) -> DataFrame:
        """Imputed, dated and encoded, not yet scaled."""
        out = add_date_features(fill_family(df, self.family_marker, self.family_fill), self.date, self.founded, self.t0)
        for column, (stats, overall) in self.target_encoders.items():
            out = apply_target_encoder(out, column, stats, overall)
        return apply_one_hot(out, self.categories)

    def transform(self, df: DataFrame) -> DataFrame:
        """Model-ready rows; serving uses the same fitted values as training."""
        return apply_scaler(self.encode(df), self.scaler)


def fit_preparation(
    train: DataFrame, target: str, date: str, founded: str, target_encoded: list[str], one_hot: list[str],
    keep: tuple[str, ...] = (), t0: str = REFERENCE_DATE, family_marker: str = "_ld_", family_fill: float = 0.0,
) -> Preparation:
    """Learn encoders and scaler; ``keep`` names numeric columns (ids) the scaler leaves alone, besides the target."""
    p = Preparation(target, date, founded, t0, family_marker, family_fill)
    p.target_encoders = {c: fit_target_encoder(train, c, target) for c in target_encoded}
    p.categories = fit_one_hot(train, one_hot)
    encoded = p.encode(train)
    p.scaler = fit_scaler(encoded, numeric_columns(encoded, (target, *keep)))
    return p
