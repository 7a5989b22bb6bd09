from pyspark.sql import functions as F

from retentio.constants import ID
from retentio.plans import sample_uploads as UP
from retentio.session import shared_scratch
from retentio.sources import files as FS
from retentio.sources.customers import source_frame
from retentio.streaming.scoring import start_scoring_stream, start_upload_stream


def test_csv_roundtrip_with_dirty_cells(spark, sf_small):
    path = shared_scratch(spark, "t-csv")
    text = UP.with_dirty_cells(FS.as_text(source_frame(spark, sf_small, "english")))
    text.write.mode("overwrite").option("header", True).csv(path)
    back = FS.read_customers(spark, path)
    assert back.count() == 150
    row = back.where(F.col(ID) == 97).first()
    assert row["age"] is None                                   # 'abc' → NULL
    assert back.where(F.col(ID) == 71).first()["lifetime_value"] == 1000.0   # '1e3'
    assert back.where(F.col(ID) == 79).first()["churned"] == 0           # 'x' → 0
    assert back.where(F.col(ID) == 67).first()["gender"] is None          # 'NA'


def test_batch_keeps_short_and_rejects_long_lines(spark, sf_small):
    path = shared_scratch(spark, "t-batch")
    text = FS.as_text(source_frame(spark, sf_small, "spanish"))
    UP.write_csv_lines(text, path, short_every=10, long_every=7)
    good, rejects = FS.read_batch(spark, path, columns=text.columns)
    assert rejects.count() == 19 and good.count() == 131                # of the 21 long ones, 2 are short instead
    assert "lifetime_value" in good.columns                      # Spanish headers normalised


def test_stream_scoring_matches_batch(spark, sf_small):
    from retentio.plans import portfolio as P
    src = shared_scratch(spark, "t-stream-in")
    text = FS.as_text(source_frame(spark, sf_small, "english"))
    text.repartition(3).write.mode("overwrite").option("header", True).csv(src)
    sink, ckpt = shared_scratch(spark, "t-stream-out"), shared_scratch(spark, "t-stream-ckpt")
    q = start_scoring_stream(spark, src, text.columns, sink, ckpt)
    q.awaitTermination()
    streamed = {int(r[ID]): r["probability"] for r in spark.read.parquet(sink).select(ID, "probability").collect()}
    batch = {r[ID]: r["probability"] for r in P.rule_scored(spark, sf_small).select(ID, "probability").collect()}
    assert streamed.keys() == batch.keys()
    assert all(abs(streamed[k] - batch[k]) < 1e-12 for k in batch)


def test_parquet_scan_with_spanish_headers_and_int_columns(spark, sf_small):
    path = shared_scratch(spark, "t-parquet")
    src = source_frame(spark, sf_small, "spanish").withColumn("Edad", F.col("Edad").cast("int"))
    src.write.mode("overwrite").parquet(path)
    back = FS.read_customers(spark, path, fmt="parquet")
    assert dict(back.dtypes)["age"] == "double" and dict(back.dtypes)["churned"] == "int"
    assert back.count() == 150 and "lifetime_value" in back.columns


def test_unreadable_upload_is_reported(spark):
    good, rejects, message = FS.try_read_batch(spark, shared_scratch(spark, "t-nothing") + "/missing.csv")
    assert good is None and rejects is None and message.startswith("could not read")


def test_a_folder_with_two_headers_is_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("customer_id,Age,Lifetime_Value,Country\n1,30,500,\"a \"\"b\"\" c\"\n2,41\n")
    (tmp_path / "b.csv").write_text("Valor_Vida_Util,Edad,customer_id\n700,50,3\n")
    rows = {r[ID]: r for r in FS.read_customers(spark, str(tmp_path)).collect()}
    assert (rows["1"]["age"], rows["1"]["lifetime_value"], rows["1"]["country"]) == (30.0, 500.0, 'a "b" c')
    assert (rows["2"]["age"], rows["2"]["lifetime_value"]) == (41.0, None)
    assert (rows["3"]["age"], rows["3"]["lifetime_value"]) == (50.0, 700.0)


def test_only_long_rows_are_rejected(spark, tmp_path):
    (tmp_path / "u.csv").write_text("customer_id,Edad,Pais\n1,30,x\n2,41\n3,5,y,z\n4,6,w,z,z\n")
    good, rejects = FS.read_batch(spark, str(tmp_path))
    assert sorted((r[ID], r["age"], r["country"]) for r in good.collect()) == [("1", 30.0, "x"), ("2", 41.0, None)]
    assert sorted(r["line"] for r in rejects.collect()) == ["3,5,y,z", "4,6,w,z,z"]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('customer_id,City\n1,"two\nlines"\n')
    assert FS.read_customers(spark, str(tmp_path), multi_line=True).first()["city"] == "two\nlines"


def test_export_has_every_column_in_order(spark, sf_small):
    from retentio.plans import portfolio as P
    path = shared_scratch(spark, "t-export")
    scored = P.rule_scored(spark, sf_small)
    FS.write_scored_csv(scored, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == scored.columns and "action" in back.columns
    files = sorted(spark.read.text(path).inputFiles())
    got = [float(r["probability"]) for f in files for r in spark.read.option("header", True).csv(f).collect()]
    assert got == sorted(got, reverse=True) and len(got) == 150


def test_a_stream_file_with_another_header_stops_the_query(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException
    (tmp_path / "a.csv").write_text("Edad,customer_id\n500,1\n")
    q = start_scoring_stream(spark, str(tmp_path), ["customer_id", "Age"], shared_scratch(spark, "t-s"), shared_scratch(spark, "t-c"))
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()


def test_a_header_is_read_to_its_end_only(spark, tmp_path):
    import io

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            got = super().read(n)
            self.seen += len(got)
            return got

    long = Counted(b'\xef\xbb\xbfa,"b\nc"\r\n' + b"1,2\n" * 1_000_000)
    assert FS.first_record(long) == 'a,"b\nc"' and long.seen == FS.BLOCK_BYTES
    assert FS.first_record(io.BytesIO(b"\n\r\na,b")) == "a,b" and FS.first_record(io.BytesIO(b"")) == ""
    assert FS.first_record(io.BytesIO(b"x" * 20_000 + b"\n1\n")) == "x" * 20_000
    try:
        FS.first_record(io.BytesIO(b"x" * 20_000 + b"\n"), limit=10_000)
    except ValueError as exc:
        assert "longer than" in str(exc)
    else:
        raise AssertionError("a header above the limit passes")


def test_quoted_line_breaks_in_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('"customer_id","No\nte",Age\n1,x,30\n')
    (tmp_path / "c.csv").write_text("Edad,customer_id\n41,2\n")
    (tmp_path / "empty.csv").write_text("")
    rows = {r[ID]: r["age"] for r in FS.read_customers(spark, str(tmp_path)).collect()}
    assert rows == {"1": 30.0, "2": 41.0}


def test_a_stream_of_mixed_headers_survives_a_failed_batch(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException
    from retentio.operators.scoring import RuleScorer

    class Failing(RuleScorer):
        def with_probability(self, df):
            raise RuntimeError("lost")

    (tmp_path / "a.csv").write_text("customer_id,Age\n1,30\n2,41\n")
    (tmp_path / "b.csv").write_text("Edad,customer_id\n50,3\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    sink, ckpt = shared_scratch(spark, "t-u"), shared_scratch(spark, "t-uc")
    start_upload_stream(spark, str(tmp_path), sink, ckpt, max_files_per_trigger=1).awaitTermination()
    (tmp_path / "d.csv").write_text("Edad,Pais,customer_id\n60,x,4\n")
    with pytest.raises(StreamingQueryException):
        start_upload_stream(spark, str(tmp_path), sink, ckpt, scorer=Failing()).awaitTermination()
    start_upload_stream(spark, str(tmp_path), sink, ckpt).awaitTermination()
    rows = sorted((r[ID], r["age"]) for r in spark.read.parquet(sink).collect())
    assert rows == [("1", 30.0), ("2", 41.0), ("3", 50.0), ("4", 60.0)]
