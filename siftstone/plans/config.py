"""Configuration: read from JSON, checked, and turned into schemas and parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import types as T

from siftstone.operators.chunking import Budget

TYPES = {"keyword": T.StringType(), "text": T.StringType(), "date": T.TimestampType(), "integer": T.IntegerType(), "float": T.FloatType(), "boolean": T.BooleanType()}
#: Columns that every chunk table has.
SYSTEM_FIELDS = {
    **dict.fromkeys(("chunk_id", "doc_id", "parent_id"), T.StringType()), **dict.fromkeys(("hierarchy_level", "position"), T.IntegerType()),
    **dict.fromkeys(("business_type", "config_version", "embedding_model_versions"), T.StringType()), "enhanced": T.BooleanType(),
}


class ConfigError(ValueError):
    """A configuration that can't be used; the message names the place."""


@dataclass(frozen=True)
class Retriever:
    id: str
    type: str
    top_k: int = 100
    weight: float = 1.0
    model_id: str | None = None
    vector_name: str | None = None
    engine: str | None = None


@dataclass(frozen=True)
class Ladder:
    recall_top_k: int = 100
    rrf_pool_k: int = 200
    rerank_top_k: int = 50
    context_top_k: int = 8


@dataclass(frozen=True)
class Config:
    version: str
    fields: tuple[dict, ...]
    embeddings: tuple[dict, ...]
    retrievers: tuple[Retriever, ...]
    budget: Budget = Budget()
    fusion_method: str = "weighted_rrf"
    fusion_k: int = 60
    rerank_enabled: bool = True
    min_score: float | None = None
    ladder: Ladder = Ladder()
    enhancement: dict = field(default_factory=dict)

    def chunk_schema(self) -> T.StructType:
        """System columns, then the declared ones."""
        declared = {f["name"]: TYPES[f["type"]] for f in self.fields if f["name"] not in SYSTEM_FIELDS}
        return T.StructType([T.StructField(name, kind) for name, kind in (SYSTEM_FIELDS | declared).items()])

    def weights(self) -> dict[str, float] | None:
        """By retriever; plain fusion has none."""
        return {r.id: r.weight for r in self.retrievers} if self.fusion_method == "weighted_rrf" else None

    def dump(self) -> dict:
        return asdict(self)


def _section(data: dict, path: str, known: set[str] | None = None, required: tuple[str, ...] = ()) -> dict:
    at = data
    for key in path.split("."):
        if not isinstance(at, dict) or key not in at:
            raise ConfigError(f"{path}: missing")
        at = at[key]
    if known is not None and (odd := set(at) - known):
        raise ConfigError(f"{path}: unknown keys {sorted(odd)}")
    if lacking := [k for k in required if k not in at]:
        raise ConfigError(f"{path}: missing keys {lacking}")
    return at


def parse_config(data: dict) -> Config:
    """Checks the shape of the sections, then what they say of each other."""
    declared = _section(data, "standard_fields.fields")
    for n, f in enumerate(declared):
        if f.get("type") not in TYPES:
            raise ConfigError(f"standard_fields.fields.{n}: unknown type {f.get('type')!r}")
    names = [f["name"] for f in declared]
    if len(set(names)) < len(names):
        raise ConfigError("standard_fields.fields: a name stands twice")
    models = _section(data, "models.embeddings")
    by_id = {m["id"]: m for m in models}
    if len(by_id) < len(models):
        raise ConfigError("models.embeddings: an id stands twice")
    allowed = {f.name for f in fields(Retriever)}
    retrievers = []
    for n, r in enumerate(_section(data, "retrieval.retrievers")):
        if odd := set(r) - allowed:
            raise ConfigError(f"retrieval.retrievers.{n}: unknown keys {sorted(odd)}")
        if r["type"] == "dense":
            if not r.get("model_id") or not r.get("vector_name"):
                raise ConfigError(f"retrieval.retrievers.{n}: a dense retriever needs model_id and vector_name")
            if r["model_id"] not in by_id:
                raise ConfigError(f"retrieval.retrievers.{n}: no model {r['model_id']!r}; there are {sorted(by_id)}")
            if by_id[r["model_id"]]["vector_name"] != r["vector_name"]:
                raise ConfigError(f"retrieval.retrievers.{n}: vector_name differs from the model's")
        retrievers.append(Retriever(**r))
    if not retrievers:
        raise ConfigError("retrieval.retrievers: empty")
    length = _section(data, "chunking.length", {"max_tokens", "overlap_tokens", "context_preservation_tokens"}, ("max_tokens",))
    if length.get("overlap_tokens", 0) >= length["max_tokens"] or length.get("context_preservation_tokens", 0) >= length["max_tokens"]:
        raise ConfigError("chunking.length: overlap and context must stay below max_tokens")
    semantic, structural = data["chunking"].get("semantic", {}), data["chunking"].get("structural", {})
    rerank, fusion = data["retrieval"].get("rerank", {}), data["retrieval"].get("fusion", {})
    if rerank.get("enabled") and not rerank.get("top_k"):
        raise ConfigError("retrieval.rerank: top_k is needed where it is enabled")
    if fusion.get("method", "weighted_rrf") not in ("rrf", "weighted_rrf"):
        raise ConfigError(f"retrieval.fusion.method: unknown {fusion['method']!r}")
    return Config(
        version=data["version"], fields=tuple(declared), embeddings=tuple(models), retrievers=tuple(retrievers),
        budget=Budget(length["max_tokens"], length.get("overlap_tokens", 0), length.get("context_preservation_tokens", 0), semantic.get("enabled", False), semantic.get("min_trigger_tokens", 256), tuple(structural.get("levels", Budget().levels)), structural.get("whole_nodes", True), semantic.get("similarity_threshold", 0.3) if semantic.get("strategy") == "similarity_drop" else None),
        fusion_method=fusion.get("method", "weighted_rrf"), fusion_k=fusion.get("k", 60), rerank_enabled=rerank.get("enabled", True), min_score=rerank.get("min_score"),
        ladder=Ladder(**data["retrieval"].get("top_k_ladder", {})), enhancement=data.get("enhancement", {}),
    )


def load_config(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except FileNotFoundError as e:
        raise ConfigError(f"{path}: no such file") from e
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path}: no JSON: {e}") from e
    try:
        return parse_config(data)
    except (KeyError, TypeError) as e:
        raise ConfigError(f"{path}: {e}") from e
