"""The operators as pipeline stages: documents in, documents out (the last gives packed pieces).

A stage keeps all columns of its input, whatever their names; where it shortens a text, a column
``n_chars`` is set to the new length.  Every stage reads texts whole, however long, and gives an empty table for one.
Null and empty texts pass every stage and are packed as their end id alone; rows with a null doc_id are treated like others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoquarry.llm import decontam, jaccard, packing, suffixes, toxicity
from memoquarry.llm.common import Scratch, keyed, lean, table, tune


#: Near copies in the pipeline: words in a shingle, and the least similarity as a fraction.
STAGE_WORDS, STAGE_NUMERATOR, STAGE_DENOMINATOR = 5, 80, 100
#: Repeated passages in the pipeline: over 50 words.
PASSAGE_WORDS = 51


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row apart, so that helper columns cannot clash with its own."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _with_text(docs: DataFrame, row: str, text: F.Column) -> list[F.Column]:
    out = []
    for c in docs.columns:
        value = F.col(f"{row}.`{c}`")
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.when(F.col("changed"), F.length(text).cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go; null and wordless texts, and all rows where labels of both kinds are missing, score the share of toxic labels.  Repeated rows are judged one by one, alike."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_rows(docs).select("row", "text"), scorer).filter("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their 5-word shingles.  Of each component the row with the smallest id (then row key) stays; texts without words stay."""
    rows = keyed(_rows(docs), Scratch(spark, "near-copies"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    kept = jaccard.classes(rows.select("rid", "doc_id", "text"), STAGE_WORDS, STAGE_NUMERATOR, STAGE_DENOMINATOR).groupBy("component").agg(F.min(place).alias("at")).select(F.col("at.rid").alias("rid"))
    return rows.select("rid", "row").join(kept, "rid", "left_semi").select("row.*")


def _cut_column(rows: DataFrame, cut, schema: str) -> DataFrame:
    """``row``, text after ``cut(text bytes, spans)`` as whole characters, and whether it changed.  Input: row, text, spans."""
    tune(rows.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = b.column(2).to_pylist()
            new = [cut(t.encode(), s).decode(errors="ignore") if s and t is not None else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array([bool(s) for s in spans], pa.bool_())], names=["row", "text", "changed"])

    return rows.select("row", "text", "spans").mapInArrow(lean(run), schema)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated passage of ``PASSAGE_WORDS`` words and every repeated string of 400 bytes (long words) goes from every text; a character that a cut splits goes too.

    Repeats are judged on the input, within a text and between texts, so rows that are still whole copies lose all that repeats; rows
    stay, if need be with an empty text.
    """
    rows = keyed(_rows(docs), Scratch(spark, "repeats"))
    schema = f"row {docs_type(docs)}, text string, changed boolean"
    done = _cut_column(suffixes.with_passages(rows, PASSAGE_WORDS), suffixes.cut_passages, schema)
    return done.select(*_with_text(docs, "row", F.col("text")))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of benchmark windows go, with what stands between them; rows stay.  An empty benchmark cuts nothing, repeated rows are cut alike."""
    hits = decontam.find_hits(_rows(docs).select("row", "text"), table(spark, sf_dir, "benchmark"))
    schema = f"row {docs_type(docs)}, text string, changed boolean"
    return _cut_column(hits, decontam.remove_hits, schema).select(*_with_text(docs, "row", F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a sequence with its token ids; every row of the input is packed once, repeated ones one by one."""
    from memoquarry.llm.registry import tokenizer_path

    return packing.pack(docs.select("doc_id", "text"), tokenizer or tokenizer_path())


def docs_type(docs: DataFrame) -> str:
    from pyspark.sql.types import StructType

    return StructType(docs.schema.fields).simpleString() if all(c.isidentifier() for c in docs.columns) else "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema.fields) + ">"


