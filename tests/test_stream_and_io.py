"""Stream scoring equals batch scoring; file round trips; model registry."""

import os
import tempfile


from shopcast.operators.entities import product_facts
from shopcast.operators.scoring import predict
from shopcast.plans.queries_ml import PRODUCT_RECORD
from shopcast.sources.files import missing_models, model_status
from shopcast.streaming.scoring import start_scoring

from conftest import SF001


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="shopcast-stream-")
    inbox, out, ckpt = (os.path.join(base, n) for n in ("in", "out", "ckpt"))
    facts = product_facts(spark, SF001)
    facts.repartition(3).write.parquet(inbox)
    q = start_scoring(spark, inbox, PRODUCT_RECORD, "sales", "product_id", out, ckpt,
                      available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{out}/predictions").drop("epoch")
    batch, _ = predict(facts, "sales", "product_id")
    cols = ["product_id", "probability", "prediction"]
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())


def test_model_registry(spark):
    root = tempfile.mkdtemp(prefix="shopcast-models-")
    os.makedirs(os.path.join(root, "model_module1", "metadata"))
    with open(os.path.join(root, "model_module1", "metadata", "part-00000"), "w") as f:
        f.write("{}")
    status = model_status(spark, root, ["model_module1", "model_module2"])
    assert [r["model"] for r in missing_models(status).collect()] == ["model_module2"]


def test_model_registry_missing_root(spark):
    status = model_status(spark, "/nonexistent/shopcast-models", ["model_module1"])
    assert [(r["model"], r["present"]) for r in status.collect()] == [("model_module1", False)]
