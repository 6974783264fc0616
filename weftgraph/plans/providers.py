"""Models behind interfaces: embedding, generation, judging, extraction. The ones here need no network and are deterministic."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, rows: list[dict], fields: Mapping[str, str]) -> list[dict]: ...


class HashingEmbedder:
    """Signed feature hashing of words: similar word sets get similar unit vectors."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)
                out[i, h % self.dim] += 1 if h // self.dim % 2 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).astype(np.float32)


class EchoGenerator:
    """Fills text fields with the start of the row's text, numbers with its length."""

    def generate(self, rows: list[dict], fields: Mapping[str, str]) -> list[dict]:
        texts = [" ".join(str(v) for v in r.values() if isinstance(v, str)) for r in rows]
        return [{f: len(t) if k in ("long", "int", "double") else t[:40] for f, k in fields.items()} for t in texts]


def embed_column(rows: DataFrame, text: str, out: str, embedder: Embedder) -> DataFrame:
    """Adds vectors in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(list(s.fillna("")))))

    return rows.withColumn(out, run(F.col(text)))


def generate(rows: DataFrame, generator: Generator, fields: Mapping[str, str], merge: str | Callable[[dict, dict], dict] = "append", batch: int = 20) -> DataFrame:
    """Rows with generated fields: appended, or with ``replace`` instead of columns of the same name; a function of the
    row and what was generated for it decides otherwise, and must give the row's columns and the new fields."""
    have = {f.name: f for f in rows.schema.fields}
    new = [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()]
    keep = [f for f in rows.schema.fields if f.name not in fields] if callable(merge) or merge in ("append", "replace") else list(have.values())
    schema = T.StructType([*keep, *new])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            records = b.to_dict("records")
            for lo in range(0, len(records), batch):
                part = records[lo : lo + batch]
                join = merge if callable(merge) else lambda r, g: {**r, **g}
                out += [join(r, g) for r, g in zip(part, generator.generate(part, fields))]
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(run, schema)


def judge(rows: DataFrame, score: Callable[[pd.DataFrame], pd.Series], key: str) -> DataFrame:
    """``id, score`` by an injected function over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b[key].astype(str), "score": score(b).astype(float)})

    return rows.mapInPandas(run, "id string, score double")


def with_summaries(rows: DataFrame, generator: Generator) -> DataFrame:
    return generate(rows, generator, {"one_line": "string", "detailed": "string", "keywords": "string"})


class Extractor(Protocol):
    def extract(self, texts: Sequence[str], domains: Sequence[Sequence[str]]) -> list[list[dict]]: ...


class PatternExtractor:
    """Names by their spelling: identifiers of several words run together, of type Symbol, without a confidence."""

    def extract(self, texts: Sequence[str], domains: Sequence[Sequence[str]]) -> list[list[dict]]:
        pattern = re.compile(r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b")
        return [[{"name": n, "type": "Symbol"} for n in dict.fromkeys(pattern.findall(t))] for t in texts]


def extract_entities(
    rows: DataFrame, extractor: Extractor, *, id_col: str = "id", text_col: str = "text", domains: str | None = None, max_chars: int | None = None, confidence: float = 0.5
) -> DataFrame:
    """``id, name, type, confidence`` by an injected extractor over Arrow batches.

    ``domains`` names a column with the domains to extract for; rows with an empty or null list are left out. Texts go
    whole unless ``max_chars`` says otherwise; an entity without confidence gets the given one. Blank texts give no row.
    """
    text = F.col(text_col) if max_chars is None else F.substring(text_col, 1, max_chars)
    d = F.col(domains) if domains else F.array().cast("array<string>")
    todo = rows.where(F.length(F.trim(text_col)) > 0)
    if domains:
        todo = todo.where(F.size(domains) > 0)
    todo = todo.select(F.col(id_col).alias("id"), text.alias("text"), d.alias("domains"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = extractor.extract(list(b["text"]), [list(x) for x in b["domains"]])
            out = [(i, e["name"], e["type"], float(e.get("confidence", confidence))) for i, es in zip(b["id"], found) for e in es]
            yield pd.DataFrame(out, columns=["id", "name", "type", "confidence"])

    return todo.mapInPandas(run, f"id {dict(todo.dtypes)['id']}, name string, type string, confidence double")
