"""Topics of documents: latent Dirichlet allocation of the ML library, topic words, topic shares by group."""

from __future__ import annotations

from pyspark.ml.clustering import LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: CountVectorizer's own limit of words, out of the way: ``least`` alone decides.
ALL_WORDS = 2**31 - 1


def fit(documents: DataFrame, topics: int = 5, least: int = 5, rounds: int = 10, seed: int = 1) -> tuple[CountVectorizerModel, LDAModel]:
    """Vectoriser and model of documents ``tokens``: every word in ``least`` documents or more, each round over every document."""
    counter = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=ALL_WORDS, minDF=least).fit(documents)
    return counter, _online(counter.transform(documents), len(counter.vocabulary), topics, rounds, seed)


def _online(counted: DataFrame, words: int, topics: int, rounds: int, seed: int) -> LDAModel:
    """Online variational Bayes as ``LDA(optimizer="online")`` has it, but with whole batches.

    The public class draws its batches with replacement: even at a rate of 1 some
    documents never come up. Only the optimizer below it can be told not to.
    """
    spark = counted.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.spark
    optimizer = jvm.mllib.clustering.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setOptimizeDocConcentration(True)
    companion = getattr(getattr(jvm.ml.clustering, "LDA$"), "MODULE$")
    rows = companion.getOldDataset(counted.select("features")._jdf, "features").cache()
    trained = jvm.mllib.clustering.LDA().setK(topics).setMaxIterations(rounds).setSeed(seed).setOptimizer(optimizer).run(rows)
    rows.unpersist(False)
    return LocalLDAModel(jvm.ml.clustering.LocalLDAModel("lda", words, trained, spark._jsparkSession)).setFeaturesCol("features").setSeed(seed)


def topic_words(counter: CountVectorizerModel, model: LDAModel, n: int = 10) -> DataFrame:
    """``topic, rank, term, weight``."""
    described = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("i", "t"))
    words = described.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "id int, term string")
    ranked = described.select("topic", (F.col("i") + 1).alias("rank"), F.col("t.termIndices").alias("id"), F.col("t.termWeights").alias("weight"))
    return ranked.join(words, "id").select("topic", "rank", "term", "weight")


def term_topics(counter: CountVectorizerModel, model: LDAModel) -> DataFrame:
    """``term, topic, weight`` of every word: its probability in each topic."""
    return topic_words(counter, model, len(counter.vocabulary)).select("term", "topic", "weight")


def coherence(documents: DataFrame, words: DataFrame, by: str) -> DataFrame:
    """``by, topic, coherence, rank`` of the topics' first ``words``: UMass coherence in the documents of each group, the most coherent topic first.

    It is the mean of ln((D(a, b) / N + 1e-12) / (D(b) / N)) over the pairs of words, b the one
    of the higher rank; nothing comes of a pair whose b the group does not have.
    """
    each = documents.filter(F.col(by).isNotNull()).select(by, F.array_distinct("tokens").alias("tokens"))
    sizes = each.groupBy(by).agg(F.count("*").alias("n"))
    listed = [r.term for r in words.select("term").distinct().collect()]  # the first words of each topic: a bounded list
    held = each.select(by, F.array_intersect("tokens", F.array(*[F.lit(w) for w in listed])).alias("held"))
    pairs = held.select(by, "held", F.explode("held").alias("a")).select(by, "a", F.explode("held").alias("b"))
    together = pairs.groupBy(by, "a", "b").agg(F.count("*").alias("n_ab"))
    alone = together.filter("a = b").select(by, "b", F.col("n_ab").alias("n_b"))
    wanted = words.select("topic", F.col("term").alias("a"), F.col("rank").alias("i")).join(words.select("topic", F.col("term").alias("b"), F.col("rank").alias("j")), "topic").filter("j < i")
    asked = sizes.join(F.broadcast(wanted)).join(alone, [by, "b"]).join(together, [by, "a", "b"], "left")
    score = F.log((F.coalesce("n_ab", F.lit(0)) / F.col("n") + 1e-12) / (F.col("n_b") / F.col("n")))
    scored = asked.groupBy(by, "topic").agg(F.avg(score).alias("coherence"))
    order = W.partitionBy(by).orderBy(F.desc(F.round("coherence", 9)), "topic")
    return scored.withColumn("rank", F.row_number().over(order))


def distributions(documents: DataFrame, counter: CountVectorizerModel, model: LDAModel) -> DataFrame:
    """The documents with ``topics``, the whole distribution as an array."""
    return model.transform(counter.transform(documents)).withColumn("topics", vector_to_array("topicDistribution")).drop("features", "topicDistribution")


def means(distributed: DataFrame, by: str) -> DataFrame:
    """``by, topic, share``: mean share of each topic in each group; null groups are left out."""
    each = distributed.filter(F.col(by).isNotNull()).select(by, F.posexplode("topics").alias("topic", "p"))
    return each.groupBy(by, "topic").agg(F.avg("p").alias("share"))


def dominant(means_: DataFrame, by: str) -> DataFrame:
    """The topic of the greatest mean share of each group; of equal ones the first."""
    best = F.max_by("topic", F.struct("share", (-F.col("topic")).alias("t"))).alias("topic")
    return means_.groupBy(by).agg(best)
