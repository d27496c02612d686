"""Vectors of windows and texts."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilite.operators.order import positions
from hilite.operators.skew import join_by_frequency
from hilite.session import written


def topic_vector(counts: DataFrame, window: list[str], topic: str, n: str, topics: list[str]) -> DataFrame:
    """A column for each topic with the window's count of it; 0 where it has none."""
    return counts.groupBy(*window).pivot(topic, topics).agg(F.sum(n)).na.fill(0, subset=topics)


def word_counts(tokens: DataFrame, window: list[str], word: str) -> DataFrame:
    """(window, word, n): the bag of words of each window."""
    return tokens.groupBy(*window, word).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tokens: DataFrame, word: str) -> DataFrame:
    """(word, token_id): ids from 0 in order of the words, numbered in slices by range, see positions."""
    return positions(tokens.select(word).where(F.col(word).isNotNull()).distinct(), [], [word], "token_id")


def tfidf(tokens: DataFrame, doc: str, word: str) -> DataFrame:
    """(doc, word, weight): tf * log2(N / df), each document's weights of length 1; words of all documents are left out.

    Counts are written once to the shared folder, frequent words and long documents salted where they are joined back. Tokens without document or word don't count.
    """
    tf = tokens.where(F.col(doc).isNotNull() & F.col(word).isNotNull()).groupBy(doc, word).agg(F.count(F.lit(1)).alias("tf"))
    tf = written(tf, "tf")
    df = tf.groupBy(word).agg(F.count(F.lit(1)).alias("df"))
    n = tf.select(F.countDistinct(doc)).scalar()
    joined = join_by_frequency(tf, word, df, "df", [doc], how="inner")
    raw = joined.select(doc, word, (F.col("tf") * F.log2(n / F.col("df"))).alias("raw")).where(F.col("raw") > 0)
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("raw") ** 2)).alias("norm"), F.count(F.lit(1)).alias("words"))
    return join_by_frequency(raw, doc, norm, "words", [word], how="inner").select(doc, word, (F.col("raw") / F.col("norm")).alias("weight"))


def zscore_columns(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, pos, z): each component less its mean over its population deviation over all rows; 0 where that is 0. The statistics, a row for each component, are broadcast."""
    long = df.select(id_, F.posexplode(vector).alias("pos", "x"))
    stats = long.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return long.join(F.broadcast(stats), "pos").select(id_, "pos", F.coalesce(F.try_divide(F.col("x") - F.col("mean"), F.col("sd")), F.lit(0.0)).alias("z"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def zscore_row(vector: Column) -> Column:
    """A vector less its mean over its population deviation; zeros where that is 0."""
    n = F.size(vector)
    stats = F.transform(F.array(F.struct((_sum(vector) / n).alias("mean"), (_sum(F.transform(vector, lambda x: x * x)) / n).alias("square"))), lambda s: F.struct(s.mean.alias("mean"), F.sqrt(F.greatest(s.square - s.mean * s.mean, F.lit(0.0))).alias("sd")))
    return F.get(F.transform(stats, lambda s: F.transform(vector, lambda x: F.coalesce(F.try_divide(x - s.mean, s.sd), F.lit(0.0)))), F.lit(0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def rbf(a: Column, b: Column, sigma: float) -> Column:
    """exp(-d^2 / (2 sigma^2))"""
    return F.exp(-_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / (2 * sigma * sigma))


def fit_lda(docs: DataFrame, words: str, *, topics: int = 8, seed: int = 1, iterations: int = 20) -> PipelineModel:
    """A model of topics over arrays of words; every different word counts, as their number is counted first."""
    different = docs.select(F.explode(words).alias("w")).agg(F.countDistinct("w")).first()[0]
    count = CountVectorizer(inputCol=words, outputCol="__counts", minDF=1, vocabSize=max(different, 1))
    return Pipeline(stages=[count, LDA(k=topics, seed=seed, maxIter=iterations, optimizer="online", featuresCol="__counts", topicDistributionCol="__topics")]).fit(docs)


def topic_weights(model: PipelineModel, docs: DataFrame, key: list[str], *, least: float = 0.01) -> DataFrame:
    """(key, topic, weight): the topic distribution of each document; weights below least count as 0 and have no row."""
    return model.transform(docs).select(*key, F.posexplode(vector_to_array("__topics")).alias("topic", "weight")).where(F.col("weight") >= least)


def lda_topics(docs: DataFrame, doc: str, words: str, *, topics: int = 8, seed: int = 1, least: float = 0.01, iterations: int = 20) -> DataFrame:
    """(doc, topic, weight): the topic distribution of each document by a model fitted to all; see topic_weights."""
    return topic_weights(fit_lda(docs, words, topics=topics, seed=seed, iterations=iterations), docs, [doc], least=least)


def word_vectors(docs: DataFrame, words: str, *, size: int = 150, least: int = 5, seed: int = 1):
    """A fitted Word2Vec model over arrays of words. Its transform gives each document the mean of its words' vectors, in place of inferred document vectors."""
    return Word2Vec(vectorSize=size, minCount=least, seed=seed, inputCol=words, outputCol="vector").fit(docs)
