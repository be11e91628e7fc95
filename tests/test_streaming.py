"""Streaming tagging resumes from its checkpoint: files that arrive later are
tagged once, files already done are not tagged again."""

from pyspark.sql import functions as F

from tagwright.operators import lexicon as LX
from tagwright.plans import fixtures as FX
from tagwright.session import scratch_path
from tagwright.sources.tables import SCHEMAS, read_table
from tagwright.streaming.tagging import run_to_completion, stream_files


def test_incremental_and_exactly_once(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    base = scratch_path(spark, "stream-test")
    inbox, sink, ckpt = f"{base}/in", f"{base}/sink", f"{base}/ckpt"
    docs.where("doc_id % 2 = 0").coalesce(1).write.parquet(f"{inbox}/a")

    def tag(df):
        return LX.polarity_rule(df.select("doc_id", "text"), "text", FX.UP, FX.DOWN) \
            .select("doc_id", "prediction")

    def src():
        return stream_files(spark, inbox, SCHEMAS["documents"], recursive=True)

    first = run_to_completion(src(), tag, sink, ckpt)
    n_first = first.count()
    docs.where("doc_id % 2 = 1").coalesce(1).write.parquet(f"{inbox}/b")
    out = run_to_completion(src(), tag, sink, ckpt)
    assert n_first == docs.where("doc_id % 2 = 0").count()
    assert out.count() == docs.count()
    assert out.select("doc_id").distinct().count() == docs.count()
    batch = {r.doc_id: r.prediction for r in tag(docs).collect()}
    assert {r.doc_id: r.prediction for r in out.collect()} == batch
    assert dict(out.groupBy("prediction").agg(F.count("*")).collect()) == {
        "hawkish": 128, "neutral": 39, "dovish": 33}


def test_table_of_one_file_or_of_part_files(spark):
    """The query tags the table whole, whether it is a file or a folder."""
    from tagwright.plans import QUERIES
    rows = spark.createDataFrame([(i, "growth is higher" if i % 2 else "the end of it", "en", "a", 1) for i in range(12)],
                                 SCHEMAS["documents"])
    base = scratch_path(spark, "stream-tables")
    rows.repartition(3).write.parquet(f"{base}/many/documents.parquet")
    rows.coalesce(1).write.parquet(f"{base}/written")
    # a plain file, put where only its name differs from the folder's
    files = spark.read.parquet(f"{base}/written").inputFiles()
    java = spark._jvm
    source = java.org.apache.hadoop.fs.Path(files[0])
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    java.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, java.org.apache.hadoop.fs.Path(f"{base}/one/documents.parquet"), False,
                                            spark._jsc.hadoopConfiguration())
    many, one = (sorted(map(tuple, QUERIES["stream_polarity_rule"](spark, f"{base}/{d}").collect())) for d in ("many", "one"))
    assert [r[0] for r in many] == list(range(12))
    assert many == one
