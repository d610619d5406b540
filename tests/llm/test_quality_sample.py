"""The bounded training sample of the quality model."""

import pytest
from pyspark.sql import functions as F

from triagedeck.llm import quality


def labelled(spark, lengths):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


def test_a_long_text_does_not_end_the_sample(spark):
    """Wherever the long ones hash, the short ones are drawn."""
    docs, labels = labelled(spark, [5000 if i % 4 == 0 else 10 for i in range(200)])
    want = docs.filter((quality.id_fold("doc_id") != 0) & (F.length("text") == 10)).count()
    got = quality.training_sample(docs, labels, sample_bytes=10_000).collect()
    assert len(got) == want and {r.label for r in got} == {0, 1}


def test_the_byte_bound_is_met_but_for_one_text(spark):
    docs, labels = labelled(spark, [10] * 300)
    assert len(quality.training_sample(docs, labels, sample_bytes=1000).collect()) == 100


def test_one_label_only_is_an_error(spark):
    docs, labels = labelled(spark, [10] * 30)
    with pytest.raises(ValueError):
        quality.quality_model(docs, labels.withColumn("quality", F.lit(1)))


def test_only_long_texts_are_an_error(spark):
    docs, labels = labelled(spark, [500] * 30)
    with pytest.raises(ValueError):
        quality.quality_model(docs, labels, sample_bytes=1000)


def test_fit_holds_the_features_once():
    """Passages of 24 MB of texts: never twice their features, besides a step's."""
    import tracemalloc

    texts = ["ab cd " * 1000 for _ in range(4000)]
    held = sum(-(-len(t) // quality.PASSAGE) for t in texts) * quality.N_FEATURES * 4
    tracemalloc.start()
    quality.fit(texts, [1] * len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert quality.SAMPLE_BYTES == 24_000_000 and peak < 1.9 * held
