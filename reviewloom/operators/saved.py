"""Preparation and model as stages of one pipeline that is saved and loaded as a whole.

``fit_pipeline`` learns imputation, encoders, scaler and model from the training rows; the pipeline it returns is an
ordinary ``PipelineModel``: ``write().overwrite().save(path)`` and ``PipelineModel.load(path)`` in any other session, and
``transform`` on tables and on streams alike (its joins are with saved tables, it has no aggregates).
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from .align import quoted
from .models import assemble, fit_assembled
from .prepare import Preparation, fit_preparation

_PLAIN = ("target", "date", "founded", "t0", "family_marker", "family_fill", "categories", "scaler")


class PreparationModel(Transformer, MLReadable, MLWritable):
    """A fitted preparation as a pipeline stage; a table without the target (a stream to be scored) is fine."""

    def __init__(self, preparation: Preparation | None = None):
        super().__init__()
        self.preparation = preparation

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.preparation.transform(dataset)

    def write(self) -> MLWriter:
        return _PreparationWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PreparationReader()


class _PreparationWriter(MLWriter):
    """Plain values as metadata, each target encoding as a Parquet table beside them."""

    def __init__(self, instance: PreparationModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        p = self.instance.preparation
        facts = {n: getattr(p, n) for n in _PLAIN}
        facts["encoders"] = [[column, overall] for column, (_, overall) in p.target_encoders.items()]
        if json.loads(json.dumps(facts)) != facts | {"scaler": {c: list(v) for c, v in p.scaler.items()}}:
            raise ValueError("categories have to be strings, numbers or booleans to be saved")
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"preparation": facts})
        for i, (stats, _) in enumerate(p.target_encoders.values()):
            stats.write.mode("overwrite").parquet(f"{path}/encoder-{i}")


class _PreparationReader(MLReader):
    def load(self, path: str) -> PreparationModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        facts = metadata["preparation"]
        encoders = {
            column: (self.sparkSession.read.parquet(f"{path}/encoder-{i}"), overall)
            for i, (column, overall) in enumerate(facts.pop("encoders"))}
        facts["scaler"] = {c: tuple(v) for c, v in facts["scaler"].items()}
        stage = PreparationModel(Preparation(**facts, target_encoders=encoders))
        stage._resetUid(metadata["uid"])
        return stage


class SignatureAssembler(Transformer, MLReadable, MLWritable):
    """The ``features`` vector in the order of the signature; missing features count as zero, other columns stay as they are."""

    def __init__(self, features: list[str] | None = None):
        super().__init__()
        self.features = features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # the row rides along under one name, so that its columns can be called anything
        packed = dataset.select(F.struct(*[quoted(c) for c in dataset.columns]).alias("_row"), *[quoted(c) for c in dataset.columns if c in set(self.features)])
        wide = assemble(packed, self.features, ("_row",))
        kept = [F.col("_row").getField(c).alias(c) for c in dataset.columns if c != "features"]
        return wide.select(*kept, "features")

    def write(self) -> MLWriter:
        return _SignatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SignatureReader()


class _SignatureWriter(MLWriter):
    def __init__(self, instance: SignatureAssembler):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"features": self.instance.features})


class _SignatureReader(MLReader):
    def load(self, path: str) -> SignatureAssembler:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = SignatureAssembler(metadata["features"])
        stage._resetUid(metadata["uid"])
        return stage


def fit_pipeline(
    train: DataFrame, target: str, date: str, founded: str, target_encoded: list[str], one_hot: list[str], features: list[str],
    kind: str, params: dict, keep: tuple[str, ...] = (), seed: int = 20,
) -> PipelineModel:
    """Preparation, feature vector and model, learnt from the training rows; ``features`` are names after preparation."""
    stages = [
        PreparationModel(fit_preparation(train, target, date, founded, target_encoded, one_hot, keep)), SignatureAssembler(features)]
    ready = train
    for stage in stages:
        ready = stage.transform(ready)
    return PipelineModel([*stages, fit_assembled(ready.select("features", quoted(target)), target, kind, params, seed=seed)])


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.read().session(spark).load(path)
