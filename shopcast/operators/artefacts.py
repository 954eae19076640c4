"""IO5: the fitted column transformer as an artefact of its own.

It is stored with the columns and types it was fitted on and a digest of them.
Loading checks the digest against the stored columns; applying checks the table's own
columns, so a table of another shape is refused before any row is read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def schema_digest(schema: T.StructType) -> str:
    """SHA-256 of names and types in order; nullability does not count."""
    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in schema.fields]).encode()).hexdigest()


@dataclass(frozen=True)
class Transformer:
    """A fitted transformer with the input columns it expects."""
    model: PipelineModel
    inputs: T.StructType
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    def check(self, schema: T.StructType) -> None:
        """Raise unless every input column is there with its type."""
        own = {f.name: f.dataType for f in schema.fields}
        wrong = [f"{f.name}: {own[f.name].simpleString() if f.name in own else 'missing'}, not {f.dataType.simpleString()}"
                 for f in self.inputs.fields if own.get(f.name) != f.dataType]
        if wrong:
            raise ValueError("the table does not have the transformer's columns: " + "; ".join(wrong))

    def transform(self, df: DataFrame) -> DataFrame:
        self.check(df.schema)
        return self.model.transform(df)


def save_transformer(transformer: Transformer, path: str) -> None:
    """Stages and input columns with their digest side by side under ``path`` (overwrite)."""
    transformer.model.write().overwrite().save(f"{path}/stages")
    facts = {"inputs": transformer.inputs.jsonValue(), "digest": schema_digest(transformer.inputs),
             "numeric": transformer.numeric, "categorical": transformer.categorical}
    SparkSession.active().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/inputs")


def load_transformer(path: str, expected: T.StructType | None = None) -> Transformer:
    """The stored transformer; ``expected`` are the columns of the table it is meant for, checked at once."""
    facts = json.loads(SparkSession.active().read.text(f"{path}/inputs").first()[0])
    inputs = T.StructType.fromJson(facts["inputs"])
    if schema_digest(inputs) != facts["digest"]:
        raise ValueError(f"the stored columns under {path} do not have the digest they were stored with")
    loaded = Transformer(PipelineModel.load(f"{path}/stages"), inputs, tuple(facts["numeric"]), tuple(facts["categorical"]))
    if expected is not None:
        loaded.check(expected)
    return loaded
