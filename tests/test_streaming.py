import pytest

from modelloom import learners as L
from modelloom.learners.base import encode_training, predict_all
from modelloom.session import shared_folder
from modelloom.sources import export
from modelloom.streaming import score_stream


def test_stream_gets_the_same_predictions(spark, part):
    data = encode_training(part, "p_retailprice", "regression", ["p_size", "p_type"])
    models = [L.DecisionTree(max_depth=4).fit(data), L.GeneralizedLinear().fit(data)]
    folder = shared_folder(spark)
    export(part, f"{folder}/in", "parquet")
    stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
    writer = score_stream(stream, models, f"{folder}/state").format("parquet").option("path", f"{folder}/out")
    writer.trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out")
    want = predict_all(part, models)
    assert got.count() == 200 and got.exceptAll(want).count() == 0
    with pytest.raises(ValueError):
        score_stream(part, models, folder)
