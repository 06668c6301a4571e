"""The fitted features as one saved pipeline.

Encoders, bins, scalers and centres are Spark ML stages, so a fit is a
``PipelineModel`` that is saved, loaded by another session and applied to rows
it has not seen.  Fitted numbers are parameters in the stage's metadata; label
codes, whose number grows with the data, are a table beside it.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators import features as fe
from blotter.operators.kmeans_batch import nearest_centre

#: Code of a label that the fit has not seen.
UNSEEN = -1


class _Fitted(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose fitted state is plain parameters."""

    columns = Param(Params._dummy(), "columns", "input column -> output column")
    stats = Param(Params._dummy(), "stats", "input column -> its two fitted numbers")

    @keyword_only
    def __init__(self, columns: dict | None = None, stats: dict | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit_of(self) -> tuple[dict, dict]:
        return self.getOrDefault(self.columns), {c: tuple(s) for c, s in self.getOrDefault(self.stats).items()}


class MinMaxColumns(_Fitted):
    """(x - min) / (max - min) with the fitted range (E5)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return fe.minmax_scale(df, *self._fit_of())


class StandardColumns(_Fitted):
    """(x - mean) / population sd with the fitted numbers."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return fe.standard_scale(df, *self._fit_of())


class BinColumns(_Fitted):
    """Equal-width right-closed bins over the fitted range; values outside it or missing fall to bin 0."""

    bins = Param(Params._dummy(), "bins", "number of bins")

    @keyword_only
    def __init__(self, columns: dict | None = None, stats: dict | None = None, bins: int | None = None):
        Transformer.__init__(self)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        columns, stats = self._fit_of()
        return fe.equal_width_bins(df, columns, self.getOrDefault(self.bins), stats=stats)


class GridColumn(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Cell id of two bin columns."""

    inputs = Param(Params._dummy(), "inputs", "the two bin columns")
    output = Param(Params._dummy(), "output", "name of the cell id")
    bins = Param(Params._dummy(), "bins", "number of bins of the second column")

    @keyword_only
    def __init__(self, inputs: list | None = None, output: str | None = None, bins: int | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault(self.output), fe.grid_id(*self.getOrDefault(self.inputs), self.getOrDefault(self.bins)))


class CalendarCodes(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Day, season and weekend as numbers (E1); nothing is fitted."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return fe.encode_temporal(df)


class CentreLabels(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Number of the nearest fitted centre (K1)."""

    inputs = Param(Params._dummy(), "inputs", "columns of the plane")
    output = Param(Params._dummy(), "output", "name of the label")
    centres = Param(Params._dummy(), "centres", "a list per centre")

    @keyword_only
    def __init__(self, inputs: list | None = None, output: str | None = None, centres: list | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        place = F.array(*[F.col(f"`{c}`").cast("double") for c in self.getOrDefault(self.inputs)])
        return df.withColumn(self.getOrDefault(self.output), nearest_centre(place, np.array(self.getOrDefault(self.centres))))


class LabelCodes(Model, MLReadable, MLWritable):
    """Codes by sorted label, missing as "nan", unseen labels as ``UNSEEN`` (E2); the codes are a table."""

    column = Param(Params._dummy(), "column", "label column")
    output = Param(Params._dummy(), "output", "name of the code")

    def __init__(self, column: str | None = None, output: str | None = None, codes: DataFrame | None = None):
        super().__init__()
        self.codes = codes
        if column is not None:
            self._set(column=column, output=output or f"{column}_Enc")

    def copy(self, extra=None):
        that = super().copy(extra)
        that.codes = self.codes
        return that

    def _transform(self, df: DataFrame) -> DataFrame:
        column, output = self.getOrDefault(self.column), self.getOrDefault(self.output)
        side = self.codes.select(F.col("value").alias("__value"), F.col("code").cast("int").alias("__code"))
        text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan"))
        out = df.withColumn("__text", text).join(side, F.col("__text") == F.col("__value"), "left")
        return out.withColumn(output, F.coalesce("__code", F.lit(UNSEEN))).drop("__text", "__value", "__code")

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader()


class _CodesWriter(MLWriter):
    def __init__(self, stage: LabelCodes):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.codes.select("value", "code").write.parquet(f"{path}/codes")


class _CodesReader(MLReader):
    def load(self, path: str) -> LabelCodes:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = LabelCodes(codes=self.sparkSession.read.parquet(f"{path}/codes"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


def fit_features(cleaned: DataFrame, lat: str = "Latitude", lon: str = "Longitude",
                 categoricals=("Primary Type", "Location Description"), bins: int = fixed.GRID_BINS, centres=None) -> PipelineModel:
    """The derived columns of :func:`features.engineer`, fitted on ``cleaned``, as a pipeline to save.

    With ``centres`` (of the scaled plane) a last stage adds ``Geo_Cluster``.
    """
    stats = {c: list(s) for c, s in fe.min_max(cleaned, [lat, lon]).items()}
    stages = [CalendarCodes(), *[LabelCodes(c, codes=fe.label_codes(cleaned, c)) for c in categoricals if c in cleaned.columns],
              BinColumns(columns={lat: "Lat_Bin", lon: "Lon_Bin"}, stats=stats, bins=bins),
              GridColumn(inputs=["Lat_Bin", "Lon_Bin"], output="Grid_ID", bins=bins),
              MinMaxColumns(columns={lat: "Lat_Scaled", lon: "Lon_Scaled"}, stats=stats)]
    if centres is not None:
        stages.append(CentreLabels(inputs=["Lat_Scaled", "Lon_Scaled"], output="Geo_Cluster", centres=[[float(x) for x in c] for c in centres]))
    return PipelineModel(stages)


def load_features(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.read().session(spark).load(path)
