"""The configured embedding models: their listing, and vectors for a few texts to try them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import dense
from siftstone.plans.config import Config

LISTED = "id string, name string, version string, vector_name string, dimension int, max_seq_len int, normalize boolean"
#: The limit of an interactive call. Ingestion embeds any number of texts.
MOST_TEXTS = 256


def models(spark: SparkSession, config: Config) -> DataFrame:
    """LISTED of each model, in the order of configuration in `ord`."""
    names = [part.split(" ")[0] for part in LISTED.split(", ")]
    text = lambda v: None if v is None else str(v)
    rows = [(n, *(text(m.get(c)) if c in ("id", "name", "version", "vector_name") else m.get(c) for c in names)) for n, m in enumerate(config.embeddings)]
    return spark.createDataFrame(rows, f"ord int, {LISTED}")


def model(config: Config, model_id: str) -> dict:
    """One model's settings; an unknown id is an error that names the known ones."""
    by_id = {m["id"]: m for m in config.embeddings}
    if model_id not in by_id:
        raise KeyError(f"no model {model_id!r}; there are {sorted(by_id)}")
    return by_id[model_id]


def embed_texts(texts: DataFrame, config: Config, providers: dict[str, Callable], model_id: str | None = None) -> DataFrame:
    """(n, model_id, vector_name, version, vector, error) of texts (n, text) under one model or all. providers: by model id. A text that a model fails on has an error and no vector."""
    if texts.limit(MOST_TEXTS + 1).count() > MOST_TEXTS:
        raise ValueError(f"at most {MOST_TEXTS} texts a call")
    chosen = [model(config, model_id)] if model_id is not None else list(config.embeddings)
    out = []
    for m in chosen:
        made = dense.embed_each(texts, providers[m["id"]], m["dimension"], text="text")
        out.append(made.select("n", F.lit(m["id"]).alias("model_id"), F.lit(m["vector_name"]).alias("vector_name"), F.lit(str(m.get("version", ""))).alias("version"), "vector", "error"))
    return reduce(DataFrame.unionAll, out)
