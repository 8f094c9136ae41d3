"""M7: text to fixed-width unit vectors with MLlib feature stages.

Hashed term counts (``HashingTF``) weighted by inverse document frequency and
scaled to unit length, so cosine similarity is a dot product.  Fitting IDF is
one distributed pass; transforming is row-local.  Any other encoder can be
plugged in through ``encoder_udf`` (an Arrow-batched pandas UDF).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 384   # width of the index vectors (source value)


def fit_embedder(texts: DataFrame, text_col: str = "text", dim: int = DIM) -> PipelineModel:
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(texts)


def embed(model: PipelineModel, df: DataFrame, out_col: str = "values") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(out_col, vector_to_array("_unit", "float32")) \
              .drop("_tok", "_tf", "_tfidf", "_unit")


def encoder_udf(encode_batch, dim: int = DIM):
    """Wrap ``encode_batch(list[str]) -> np.ndarray[n, dim]`` as a pandas UDF."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def _enc(texts: pd.Series) -> pd.Series:
        arr = encode_batch(texts.fillna("").tolist())
        return pd.Series([row.astype("float32") for row in arr])
    return _enc
