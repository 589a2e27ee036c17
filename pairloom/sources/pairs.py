"""Readers and writers: pair CSV, pairs derived from documents, vectors, dictionaries, features, predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.sources import splits
from pairloom.sources.splits import SENTENCE

TRAIN_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "qid1", "qid2")] + [T.StructField(n, T.StringType()) for n in ("question1", "question2")] + [T.StructField("is_duplicate", T.IntegerType())])
TEST_SCHEMA = T.StructType([T.StructField("test_id", T.LongType()), T.StructField("question1", T.StringType()), T.StructField("question2", T.StringType())])
PREDICTION_SCHEMA = T.StructType([T.StructField("test_id", T.LongType()), T.StructField("is_duplicate", T.DoubleType())])
BLOCK_MATES, KEY_WORDS = 3, 60
ID_STEP = 1_000_000_000


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_train_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, TRAIN_SCHEMA).withColumnRenamed("id", "pair_id").withColumn("split", F.lit("train"))


def read_test_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, TEST_SCHEMA).withColumnRenamed("test_id", "pair_id").withColumn("split", F.lit("test"))


def combined(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test pairs in one table; columns that one lacks are null there."""
    return train.unionByName(test, allowMissingColumns=True)


def _first_words() -> Column:
    return F.slice(F.split("text", "[ \\n\\r\\t]+", KEY_WORDS + 1), 1, KEY_WORDS)


def _question(first: Column) -> Column:
    return F.array_join(F.slice(first, 1, 12), " ")


def _block() -> Column:
    """The key of a question's block: its first two words."""
    return F.array_join(F.slice(F.split(F.lower("question"), " "), 1, 2), " ")


def questions_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, question, blk) of all documents: for queries that compare all documents of a block, not the next ones only."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _question(_first_words()).alias("question")).withColumn("blk", _block())


def pairs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question pairs from the first 12 words of documents that share their first two words, and of neighbours."""
    # cut after the words that count, so that the rest of a long text is not scanned
    first = _first_words()
    q = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id"),
        _question(first).alias("question"),
        F.array_distinct(F.transform(first, F.lower)).alias("tk"),
    )
    # ids and blocks only in the window; texts join later
    w = Window.partitionBy("blk").orderBy("doc_id")
    mates = q.select("doc_id", _block().alias("blk")).select("doc_id", F.array(*[F.lead("doc_id", k).over(w) for k in range(1, BLOCK_MATES + 1)]).alias("next"))
    ids = mates.select(F.col("doc_id").alias("d1"), F.explode("next").alias("d2")).filter("d2 is not null")
    ids = ids.union(q.select("doc_id", F.col("doc_id") + 1)).distinct()
    a = q.select(F.col("doc_id").alias("qid1"), F.col("question").alias("question1"), F.col("tk").alias("tk1"))
    b = q.select(F.col("doc_id").alias("qid2"), F.col("question").alias("question2"), F.col("tk").alias("tk2"))
    shared = F.size(F.array_intersect("tk1", "tk2"))
    return (
        ids.join(a, ids.d1 == a.qid1).join(b, ids.d2 == b.qid2)
        .select(
            (F.col("qid1") * ID_STEP + F.col("qid2")).alias("pair_id"), "qid1", "qid2", "question1", "question2",
            (shared * 10 >= 6 * (F.size("tk1") + F.size("tk2") - shared)).cast("int").alias("is_duplicate"),
        )
        .withColumn("split", F.when(F.col("pair_id") % 5 == 0, "test").otherwise("train"))
    )


#: The same table for DuckDB, as the head of a WITH clause.
PAIRS_SQL = f"""q AS (SELECT doc_id,
    array_to_string(list_slice(string_split(regexp_replace(text,'[ \\n\\r\\t]+',' ','g'),' '),1,12),' ') AS question,
    list_distinct(list_slice(string_split(regexp_replace(lower(text),'[ \\n\\r\\t]+',' ','g'),' '),1,60)) AS tk FROM documents),
k AS (SELECT *, array_to_string(list_slice(string_split(lower(question),' '),1,2),' ') AS blk FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY doc_id) rn FROM k),
e AS (SELECT a.doc_id d1, b.doc_id d2 FROM r a JOIN r b ON a.blk=b.blk AND b.rn-a.rn BETWEEN 1 AND {BLOCK_MATES}
      UNION SELECT a.doc_id, b.doc_id FROM q a JOIN q b ON b.doc_id=a.doc_id+1),
pairs AS (SELECT d1*{ID_STEP}+d2 AS pair_id, d1 AS qid1, d2 AS qid2, a.question AS question1, b.question AS question2,
  CASE WHEN len(list_intersect(a.tk,b.tk))*10 >= 6*(len(a.tk)+len(b.tk)-len(list_intersect(a.tk,b.tk))) THEN 1 ELSE 0 END AS is_duplicate,
  CASE WHEN (d1*{ID_STEP}+d2) % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM e JOIN q a ON a.doc_id=d1 JOIN q b ON b.doc_id=d2)"""


def read_word_vectors(spark: SparkSession, path: str, dims: int, header: bool = False) -> DataFrame:
    """(word, vec) from a text file of word and numbers, with or without a header line of counts."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > dims)
    rows = rows.filter(F.size("p") != 2) if header else rows
    # a word may hold spaces: the numbers are the last ones
    return rows.select(F.array_join(F.slice("p", 1, F.size("p") - dims), " ").alias("word"), F.slice("p", F.size("p") - dims + 1, dims).cast("array<float>").alias("vec"))


def read_word_vectors_binary(spark: SparkSession, path: str, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """(word, vec) of files in the binary word-vector format, of any size, cut into ranges of split_bytes; 0: a task a file."""
    spark.dataSource.register(splits.WordVectors)
    return spark.read.format("word_vectors").option("split_bytes", split_bytes).load(path)


def read_dictionary(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """(pos, word, other) from a JSON object word -> [words]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("word", "others"))
    return rows.select(F.lit(pos).alias("pos"), "word", F.explode("others").alias("other"))


def write_features(df: DataFrame, path: str) -> None:
    """One Parquet table for all splits, keyed by pair_id."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_features(spark: SparkSession, folder: str, families: list[str]) -> DataFrame:
    """The written feature tables of a folder side by side, by pair_id: one shuffle a family, each by the same key.

    Pairs that a family lacks are left out; a column that two families name is an error.
    """
    tables = [spark.read.parquet(f"{folder.rstrip('/')}/{name}").drop("split") for name in families]
    names = [c for t in tables for c in t.columns if c != "pair_id"]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"columns of more than one family: {twice}")
    return reduce(lambda a, b: a.join(b, "pair_id"), tables)


def read_annotated_pickles(spark: SparkSession, path: str, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """(pair_id, is_duplicate, question1, question2, s, t) from files of pickled annotated pairs, gzipped or not.

    A file is one stream of dictionaries (id, is_duplicate, q1 and q2 with raw, toks and deps), of any size. A gzipped
    one is cut at its members, which must hold whole dictionaries; others go to one task. Values are plain data: code in
    a file is refused. A pair without the key of the test split has a null label.
    """
    spark.dataSource.register(splits.AnnotatedPickles)
    return spark.read.format("annotated_pickles").option("split_bytes", split_bytes).load(path)


def write_annotated(df: DataFrame, path: str) -> None:
    """Annotated pairs as Parquet: the nested layout is kept, and files split over tasks when read again."""
    df.write.mode("overwrite").parquet(path)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_pickled_rows(spark: SparkSession, path: str, schema: str, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """Rows of files that each hold pickled lists of tuples (or scalars, for one column), in the given schema.

    Files of plain values only, cut as by read_annotated_pickles. Parquet is the format to write: see write_features
    and write_predictions.
    """
    spark.dataSource.register(splits.PickledRows)
    return spark.read.format("pickled_rows").schema(schema).option("split_bytes", split_bytes).load(path)


def write_predictions(df: DataFrame, path: str, calibrated: DataFrame | None = None) -> None:
    """(test_id, is_duplicate) as CSV, raw and, if given, calibrated."""
    df.write.mode("overwrite").csv(f"{path}/raw", header=True)
    if calibrated is not None:
        calibrated.write.mode("overwrite").csv(f"{path}/calibrated", header=True)


def annotate(pairs: DataFrame, annotator, columns: tuple[str, str] = ("question1", "question2")) -> DataFrame:
    """Parsed sentences s and t of each pair by a pluggable annotator(text) -> [(word, pos, ner, {head: label})].

    A text that fails is tried once more without % " and '; one that fails again gives null, and
    the pair stays. Null texts are the text 'Null'.
    """

    def run(it):
        for pdf in it:
            for side, column in zip(("s", "t"), columns, strict=True):
                pdf[side] = [_annotated(annotator, x) for x in pdf[column]]
            yield pdf[["pair_id", "s", "t"]]

    return pairs.select("pair_id", *columns).mapInPandas(run, f"pair_id bigint, s {SENTENCE}, t {SENTENCE}")


def _annotated(annotator, text: str | None):
    text = "Null" if text is None else text
    for attempt in (text, text.translate({ord(c): None for c in "%\"'"})):
        try:
            return [{"word": w.lower(), "pos": p, "ner": n, "deps": d} for w, p, n, d in annotator(attempt)]
        except Exception:  # noqa: BLE001 - any failure of a plugged-in annotator is a null annotation
            continue
    return None
